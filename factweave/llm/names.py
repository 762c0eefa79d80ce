"""Problem 4: variant spellings of names, linked by metric-space partitioning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import groups
from factweave.llm import name_forms as N
from factweave.plans.lineage import discard, measured, stored
from factweave.sources.tables import table

#: Radius of the join in plain edit distance; two plain edits make a transposition.
RADIUS = 2
#: Letters from which a word is held against others by its ends.
LONG_WORD = 48
#: Different full names that use a mailbox before it counts as shared.
SHARED_BOX = 3
#: Members of an entity that one task pairs with as many others.
BLOCK = 2048

_FORM = "key string, src string, org boolean, kind string, first string, last string, whole string, identity string, box string"
_CELL = "kind string, s string, cell int, d int, home boolean"


# ---------------------------------------------------------------- the metric join
def distances(strings: Sequence[str], pivots: Sequence[str]) -> np.ndarray:
    """Edit distances of all strings to all pivots, a row per string.

    The strings of about one length are one matrix of code points; a row of the usual table is
    computed for all of them at once, where the running minimum along the row carries insertions.
    """
    out = np.empty((len(strings), len(pivots)), dtype=np.int32)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    marks = [[ord(c) for c in p] for p in pivots]
    for bits in {int(n).bit_length() for n in sizes}:
        at = np.flatnonzero((sizes < 2**bits) & (sizes >= 2**bits // 2))
        wide = int(sizes[at].max())
        letters = np.zeros((len(at), wide), dtype=np.int32)
        for row, i in enumerate(at):
            letters[row, : sizes[i]] = [ord(c) for c in strings[i]]
        steps, ends = np.arange(wide + 1, dtype=np.int32), np.arange(len(at))
        for no, pivot in enumerate(marks):
            row = np.broadcast_to(steps, (len(at), wide + 1))
            for i, c in enumerate(pivot, 1):
                new = np.empty((len(at), wide + 1), dtype=np.int32)
                new[:, 0] = i
                np.minimum(row[:, 1:] + 1, row[:, :-1] + (letters != c), out=new[:, 1:])
                new -= steps
                np.minimum.accumulate(new, axis=1, out=new)
                new += steps
                row = new
            out[at, no] = row[ends, sizes[at]]
    return out


def within(strings: DataFrame, radius: int = RADIUS, pivots: int | None = None) -> DataFrame:
    """``kind, a, b`` (``a < b``): all pairs of strings of a kind at most ``radius`` edits apart.

    ``strings(kind, s)``, distinct and not blank. Every string lives in the cell of its nearest
    pivot. If ``d(x, y) <= r`` and ``p`` is the pivot of ``x``, then ``d(y, p) <= d(y, q) + 2 r``
    for the pivot ``q`` of ``y``, so ``y`` is also copied to every pivot that near; of two cells
    that both hold a pair the first one reports it. Inside a cell the triangle inequality leaves
    strings whose distances to the pivot differ by at most ``r``, and so do their distances to
    the empty string, their lengths. These rings are joined by equality and the rest is decided
    by the true distance. Nothing is lost at any radius, and no pair comes out twice.

    There are as many pivots as the root of the strings (31,623 for a billion); they are a hash
    sample and all that goes to every task.
    """
    spark = strings.sparkSession
    words, seen = measured(strings.select("kind", "s"), "words", n=F.count(F.lit(1)))
    k = pivots or max(1, int(seen["n"] ** 0.5))
    sample = sorted({r[0] for r in words.orderBy(F.xxhash64("s"), "s").limit(k).collect()} or {""})
    shared = spark.sparkContext.broadcast(sample)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = distances(list(batch["s"]), shared.value) if len(batch) else np.empty((0, len(shared.value)), dtype=np.int32)
            home = d.argmin(axis=1) if len(batch) else np.empty(0, dtype=int)
            near = d <= d.min(axis=1, initial=2**30)[:, None] + 2 * radius
            row, cell = np.nonzero(near & (np.arange(d.shape[1]) <= home[:, None]))
            yield pd.DataFrame({"kind": batch["kind"].to_numpy()[row], "s": batch["s"].to_numpy()[row], "cell": cell, "d": d[row, cell], "home": cell == home[row]})

    placed = stored(words.mapInPandas(place, _CELL), "cells")
    around = [F.explode(F.sequence(c - radius, c + radius)) for c in (F.col("d"), F.length("s"))]
    left = placed.where("home").withColumn("ring", around[0]).withColumn("size", around[1]).select("kind", "cell", "ring", "size", F.col("s").alias("x"))
    right = placed.select("kind", "cell", F.col("d").alias("ring"), F.length("s").alias("size"), F.col("s").alias("y"), F.col("home").alias("both"))
    met = left.join(right.hint("merge"), ["kind", "cell", "ring", "size"]).where((F.col("x") < F.col("y")) | (~F.col("both") & (F.col("x") > F.col("y"))))
    close = met.where(F.levenshtein(F.col("x"), F.col("y"), radius) >= 0)
    return close.select("kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


@F.pandas_udf(T.IntegerType())
def _damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([N.damerau(x, y) for x, y in zip(a, b)], dtype="int32")


def slip_keys(word: str) -> list[str]:
    """Texts of which any two words one edit or transposition apart have one in common.

    These are the word and what is left of it without one letter. Of a long word, which has too
    many of those, nearly half at each end, as a slip leaves one end as it is; a neighbour may be
    a letter shorter or longer, so the ends are those of all three lengths.
    """
    n = len(word)
    keys = {f"1{word}"} | {f"1{word[:i]}{word[i + 1:]}" for i in range(n)} if n <= LONG_WORD + 1 else set()
    if n >= LONG_WORD:
        for m in {x // 2 - 1 for x in (n - 1, n, n + 1)}:
            keys |= {f"<{word[:m]}", f">{word[n - m :]}"}
    return sorted(keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _slip_keys(word: pd.Series) -> pd.Series:
    return word.map(slip_keys)


def one_slip(strings: DataFrame) -> DataFrame:
    """``kind, a, b`` (``a < b``): all pairs of ``strings(kind, s)``, distinct and not blank, one edit or transposition apart.

    They meet by equality of what a slip leaves, so the work grows with the strings.
    """
    k = strings.select("kind", "s", F.explode(_slip_keys("s")).alias("k"))
    a, b = (k.select("kind", F.xxhash64("k").alias("h"), F.col("s").alias(x)) for x in "ab")
    met = a.join(b.hint("merge"), ["kind", "h"]).where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", RADIUS) >= 0))
    return met.select("kind", "a", "b").distinct().where(_damerau("a", "b") <= 1)


def canonical(words: DataFrame) -> DataFrame:
    """``kind, s, canon``: the spelling of which ``s`` is a slip, by one edit or transposition after another.

    ``words(kind, s, n)`` with the records that use a spelling. A slip is one used much less
    than the spelling it is near to; of two rare ones the more used, then the smaller, stands.
    Of first names (kind ``f``), which lie close together, only rare ones near a common one are
    slips. A slip of a slip leads on to the end, however long the chain is.
    """
    near = one_slip(words.select("kind", "s"))
    both = near.union(near.select("kind", "b", "a"))
    sized = words.select("kind", F.col("s").alias("a"), F.col("n").alias("na")).join(both.hint("merge"), ["kind", "a"])
    sized = sized.join(words.select("kind", F.col("s").alias("b"), F.col("n").alias("nb")).hint("merge"), ["kind", "b"])
    much, rare = F.col("nb") >= 3 * F.col("na"), F.col("na") <= 2
    stands = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    slip = F.when(F.col("kind") == "f", much & rare).otherwise(much | (rare & stands))
    best = sized.where(slip).groupBy("kind", F.col("a").alias("s")).agg(F.max_by("b", F.struct("nb", "b")).alias("to"))
    node = F.concat_ws(":", "kind", "s")
    known = words.select("kind", "s").join(best.hint("merge"), ["kind", "s"], "left")
    tree = stored(known.select(node.alias("node"), F.concat_ws(":", "kind", F.coalesce("to", "s")).alias("parent")), "slips")
    ends = groups.collapse(tree)
    return ends.select(F.substring("node", 1, 1).alias("kind"), F.expr("substr(node, 3)").alias("s"), F.expr("substr(parent, 3)").alias("canon"))


# ---------------------------------------------------------------- reading
def records(pairs: DataFrame) -> DataFrame:
    """``key, mention, type, emails``: every record of ``pairs(a, b)`` once, its e-mails united."""
    side = [F.struct(groups.record_key(s).alias("key"), F.col(f"{s}.mention").alias("mention"), F.col(f"{s}.type").alias("type"), F.col(f"{s}.emails").alias("emails")) for s in "ab"]
    rows = pairs.select(F.explode(F.array(*side)).alias("r")).select("r.*").where("key is not null")
    mailed = F.when(F.col("mention").rlike(r"^\s*\S+@\S+\.\S+\s*$"), F.array("mention")).otherwise(F.array())
    rows = rows.withColumn("emails", F.concat(F.coalesce("emails", F.array()), mailed))
    return rows.groupBy("key").agg(F.min("mention").alias("mention"), F.min("type").alias("type"), F.array_distinct(F.flatten(F.collect_set("emails"))).alias("emails"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for the mention of every record (``m``), one for every mailbox of a person (``e``)."""
    none = (None,) * 4
    for batch in batches:
        rows = []
        for key, mention, kind, emails in zip(batch["key"], batch["mention"], batch["type"], batch["emails"]):
            org = (kind or "").strip().lower() == "org"
            rows.append((key, "m", org, *(N.read(mention, kind) or none), None, None))
            if not org:
                mails = {N.email_identity(e) for e in emails} - {None}
                rows += [(key, "e", False, *(N.handle(e) or none), e, N.domain_family(e)) for e in sorted(mails)]
        yield pd.DataFrame(rows, columns=["key", "src", "org", "kind", "first", "last", "whole", "identity", "box"], dtype=object)


# ---------------------------------------------------------------- words of people
def _leads(rows: DataFrame) -> DataFrame:
    """``word, lead``: how often a word stands first among the names in which it stands."""
    two = rows.where("kind in ('two', 'sure') and last is not null")
    ends = two.select(F.explode(F.array(F.struct(F.col("first").alias("word"), F.lit(1).alias("at")), F.struct(F.col("last").alias("word"), F.lit(0).alias("at")))).alias("x"))
    return ends.where("length(x.word) > 1").groupBy("x.word").agg(F.avg("x.at").alias("lead"))


def _oriented(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Puts the first name first where the order of two words was open."""
    a = firsts.select(F.col("word").alias("first"), F.col("lead").alias("la")).hint("merge")
    b = firsts.select(F.col("word").alias("last"), F.col("lead").alias("lb")).hint("merge")
    swap = (F.col("kind") == "two") & (F.coalesce("lb", F.lit(0.5)) > F.coalesce("la", F.lit(0.5)))
    fixed = rows.join(a, "first", "left").join(b, "last", "left")
    keep = [c for c in rows.columns if c not in ("first", "last")]
    return fixed.select(*keep, F.when(swap, F.col("last")).otherwise(F.col("first")).alias("first"), F.when(swap, F.col("first")).otherwise(F.col("last")).alias("last"))


def _split(whole: DataFrame, firsts: DataFrame, lasts: DataFrame) -> DataFrame:
    """``whole, f, l`` of words that are a first name or initial run together with a last name."""
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("whole") - 3, F.lit(1))))
    cuts = whole.distinct().withColumn("i", at).select("whole", F.expr("left(whole, i)").alias("p"), F.expr("substr(whole, i + 1)").alias("q"))
    cuts = cuts.select("whole", F.explode(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q")))).alias("x")).select("whole", "x.p", "x.q")
    named = cuts.join(lasts.select(F.col("s").alias("q"), "n").hint("merge"), "q")
    named = named.join(firsts.where("lead > 0.5").select(F.col("word").alias("p"), F.lit(True).alias("whole_name")).hint("merge"), "p", "left")
    fits = named.where((F.length("p") == 1) | F.col("whole_name"))
    best = fits.groupBy("whole").agg(F.max_by(F.struct("p", "q"), F.struct(F.length("p"), "n", "p")).alias("x"))
    return best.select("whole", F.col("x.p").alias("f"), F.col("x.q").alias("l"))


def person_forms(rows: DataFrame) -> DataFrame:
    """The rows of people with first and last names told apart and taken apart, stored."""
    firsts = _leads(rows)
    turned = stored(_oriented(rows, firsts), "turned-names")
    lasts = turned.where("length(last) > 1").groupBy(F.col("last").alias("s")).agg(F.count_distinct("key").alias("n"))
    cut = _split(turned.where("kind = 'joined'").select("whole"), firsts, lasts)
    filled = turned.join(cut.hint("merge"), "whole", "left")
    out = stored(filled.select("key", "src", "identity", "box", F.coalesce("first", "f").alias("first"), F.coalesce("last", "l").alias("last"), F.col("last").alias("said")), "person-names")
    discard(turned)
    return out


# ---------------------------------------------------------------- words of organisations
def _stands_for(short: Column, long: Column) -> Column:
    """Whether ``short`` abbreviates ``long``: its beginning, or some of its letters in order up to the last."""
    spread = F.regexp_replace(short, r"(.)", r"$1.*")
    letters = F.rlike(long, F.concat(F.lit("^"), spread, F.lit("$"))) & (F.right(short, F.lit(1)) == F.right(long, F.lit(1)))
    return (F.length(short) < F.length(long)) & (long.startswith(short) | letters)


def short_keys(word: str) -> list[str]:
    """What ``word`` shares with every longer word that it may abbreviate."""
    n = len(word)
    return [f"<{word[:4]}"] + ([f"{min(n, 4)}{word[: min(n, 4) - 1]}{word[-1]}"] if n else [])


def long_keys(word: str) -> list[str]:
    """The ``short_keys`` of everything that may abbreviate ``word``; bounded by the alphabet."""
    keys = {f"<{word[:i]}" for i in range(1, 5)}
    if len(word) > 1:
        first, last, seen = word[0], word[-1], set()
        keys.add(f"2{first}{last}")
        if first == last:
            keys.add(f"1{last}")
        for y in word[1:-1]:
            keys.update(f"4{first}{x}{y}{last}" for x in seen)
            keys.add(f"3{first}{y}{last}")
            seen.add(y)
    return sorted(keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _short_keys(word: pd.Series) -> pd.Series:
    return word.map(lambda w: short_keys(w) if w else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _long_keys(word: pd.Series) -> pd.Series:
    return word.map(lambda w: long_keys(w) if w else [])


def abbreviations(shorts: DataFrame, longs: DataFrame) -> DataFrame:
    """``short, long``: all pairs of ``shorts(short)`` and ``longs(long)`` where one stands for the other."""
    a = shorts.distinct().select("short", F.explode(_short_keys("short")).alias("k"))
    b = longs.distinct().select("long", F.explode(_long_keys("long")).alias("k"))
    return a.join(b.hint("merge"), "k").where(_stands_for(F.col("short"), F.col("long"))).select("short", "long").distinct()


def organisation_forms(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, first, last`` of organisations with words run together taken apart, and ``word, k, n`` of full second words."""
    seconds = raw.where("kind = 'org'").groupBy(F.col("last").alias("word")).agg(F.count_distinct("first").alias("k"), F.count(F.lit(1)).alias("n"))
    full = stored(seconds.where("length(word) >= 4"), "second-words")
    met = abbreviations(full.select(F.col("word").alias("short")), full.select(F.col("word").alias("long")))
    met = met.join(full.select(F.col("word").alias("short"), "n").hint("merge"), "short").join(full.select(F.col("word").alias("long"), F.col("n").alias("ln")).hint("merge"), "long")
    words = stored(full.join(met.where("ln >= n").select(F.col("short").alias("word")).distinct().hint("merge"), "word", "left_anti"), "org-words")
    at = F.explode(F.sequence(F.lit(3), F.greatest(F.length("whole") - 3, F.lit(3))))
    cuts = raw.where("kind = 'org1'").select("whole").distinct().withColumn("i", at)
    cuts = cuts.select("whole", F.expr("left(whole, i)").alias("p"), F.expr("substr(whole, i + 1)").alias("word")).join(words.where("k >= 2").hint("merge"), "word")
    best = cuts.groupBy("whole").agg(F.max_by(F.struct("p", "word"), F.struct(F.length("word"), "n", "word")).alias("x"))
    cut = best.select("whole", F.col("x.p").alias("p"), F.col("x.word").alias("q"))
    split = raw.join(cut.hint("merge"), "whole", "left").select("key", F.coalesce("p", "first").alias("first"), F.coalesce("q", "last").alias("last"))
    return stored(split, "org-names"), words


# ---------------------------------------------------------------- who is who
def people(forms: DataFrame, canon: DataFrame) -> DataFrame:
    """``key, entity`` of the records that are no organisations.

    A person is a mailbox or, without one, a full name. Records with a full name that only one
    mailbox has belong to it; where two people share a name, those without a mailbox stay
    alone, as do initials and first names that fit more than one person.
    """
    own, mail = F.col("src") == "m", F.col("src") == "e"
    # What the mailbox says completes an initial or a first name alone.
    per = forms.groupBy("key").agg(
        F.max(F.when(own, F.col("first"))).alias("first"), F.max(F.when(own, F.col("last"))).alias("last"),
        F.max(F.when(mail & (F.length("first") > 1), F.struct("first", "last"))).alias("full"),
        F.max(F.when(mail & F.col("last").isNotNull(), F.struct("last", "first"))).alias("part"),
        F.collect_set(F.when(mail, F.struct("identity", "box"))).alias("boxes"),
    )
    fits_first = F.col("full.first").startswith(F.substring("first", 1, 1)) & (F.length("first") == 1)
    first = F.when(fits_first & (F.col("full.last") == F.col("last")), F.col("full.first")).when(F.col("first").isNull(), F.coalesce("full.first", "part.first")).otherwise(F.col("first"))
    last = F.coalesce("last", F.when(F.substring("part.first", 1, 1) == F.substring("first", 1, 1), F.col("part.last")), F.when(F.col("first").isNull(), F.col("part.last")))
    named = per.select("key", first.alias("first"), last.alias("last"), "boxes")
    mended = canon.where("kind = 'l'").select(F.col("s").alias("last"), F.col("canon").alias("cl")).hint("merge")
    nearby = canon.where("kind = 'f' and s <> canon").select(F.col("s").alias("first"), F.col("canon").alias("cf")).hint("merge")
    named = named.join(mended, "last", "left").join(nearby, "first", "left")
    named = stored(named.select("key", "first", F.coalesce("cl", "last").alias("last"), "cf", "boxes"), "person-words")
    formal = stored(_formal(named), "persons")
    discard(named)

    boxes = formal.select("key", "first", "last", F.explode("boxes").alias("b")).select("key", "first", "last", "b.*")
    shared = boxes.where("length(first) > 1").groupBy("identity").agg(F.count_distinct("first", "last").alias("k")).where(F.col("k") >= SHARED_BOX)
    family = boxes.join(shared.select("identity").hint("merge"), "identity", "left_anti").select(F.col("key").alias("u"), F.concat(F.lit("@"), "box").alias("v"))
    linked = groups.components(formal.select(F.lit(None).cast("string").alias("node")), family)
    mailed = linked.where(~F.col("node").startswith("@")).select(F.col("node").alias("key"), F.concat(F.lit("m:"), "group_id").alias("box"))
    all_ = stored(formal.select("key", "first", "last").join(mailed.hint("merge"), "key", "left"), "boxed-persons")

    full = all_.where("length(first) > 1 and last is not null")
    per = full.groupBy("first", "last").agg(F.count_distinct("box").alias("boxes"), F.min("box").alias("only"))
    by_name = F.concat_ws(" ", F.lit("n:"), "first", "last")
    entity = F.coalesce("box", F.when(F.col("boxes") == 0, by_name).when(F.col("boxes") == 1, F.col("only")))
    settled = stored(full.join(per.hint("merge"), ["first", "last"]).select("key", "last", F.substring("first", 1, 1).alias("i"), "boxes", entity.alias("entity")), "settled-persons")
    # Somebody whose name is shared but who has no mailbox makes the initial open as well.
    fits = settled.groupBy("last", "i").agg(
        F.count_distinct("entity").alias("k"), F.min("entity").alias("e"), F.max(F.when(F.col("entity").isNotNull(), F.col("boxes"))).alias("boxes"),
        F.bool_or(F.col("entity").isNull()).alias("open"),
    )
    short = all_.where("length(first) = 1 and last is not null").select("key", F.col("first").alias("i"), "last", "box")
    used = settled.select(F.col("entity").alias("box")).where("box is not null").distinct().withColumn("used", F.lit(True))
    tried = short.join(fits.hint("merge"), ["last", "i"], "left").join(used.hint("merge"), "box", "left")
    alone = ~F.col("open") & (F.col("k") == 1)
    who = F.when(F.col("used"), F.col("box")).when(F.col("box").isNull() & alone, F.col("e")).when(F.col("box").isNotNull() & alone & (F.col("boxes") == 0), F.col("e")).otherwise(F.col("box"))
    rest = all_.where("first is null or last is null").select("key", F.col("box").alias("entity"))
    return settled.select("key", "entity").unionByName(tried.select("key", who.alias("entity"))).unionByName(rest).where("entity is not null")


def _formal(named: DataFrame) -> DataFrame:
    """``key, first, last, boxes`` with the first name that somebody of the same last name has.

    For a short form that is the only long form of it in use there, else its usual one; for a
    slip (``cf``) the name it is near to, if somebody there has it. The short forms are a fixed
    list, so it is broadcast.
    """
    spark = named.sparkSession
    short = F.broadcast(spark.createDataFrame([(k, v.split()) for k, v in N.NICKNAMES.items()], "first string, longs array<string>"))
    known = named.join(short, "first", "left")
    options = known.where("longs is not null or cf is not null").select("key", "last", F.explode(F.array_compact(F.concat(F.coalesce("longs", F.array()), F.array("cf")))).alias("long"))
    full = named.where("length(first) > 1").select("last", F.col("first").alias("long")).distinct()
    one = options.join(full.hint("merge"), ["last", "long"]).groupBy("key").agg(F.count_distinct("long").alias("k"), F.min("long").alias("long")).where("k = 1").select("key", "long")
    return known.join(one.hint("merge"), "key", "left").select("key", F.coalesce("long", F.try_element_at("longs", F.lit(1)), "first").alias("first"), "last", "boxes")


def organisations(forms: DataFrame, words: DataFrame, canon: DataFrame) -> DataFrame:
    """``key, entity`` of organisations: first word (slips mended) and second word (written out).

    A first word alone belongs to an organisation if only one begins with it.
    """
    mended = canon.where("kind = 'o'").select(F.col("s").alias("first"), F.col("canon").alias("c")).hint("merge")
    named = stored(forms.join(mended, "first").select("key", F.col("c").alias("first"), "last"), "orgs")
    # Short second words are written out, if possible as another record of the same first word has it.
    common = words.where("k >= 2").select("word", F.col("n").alias("wn"))
    met = abbreviations(named.select(F.col("last").alias("short")).where("short is not null"), common.select(F.col("word").alias("long")))
    fits = stored(met.join(common.withColumnRenamed("word", "long").hint("merge"), "long").select(F.col("short").alias("last"), F.col("long").alias("word"), "wn"), "written-out")
    usual = fits.groupBy("last").agg(F.max_by("word", F.struct("wn", "word")).alias("usual"))
    have = named.select("first", F.col("last").alias("word")).distinct()
    near = named.select("first", "last").distinct().join(fits.hint("merge"), "last").join(have.hint("merge"), ["first", "word"])
    near = near.groupBy("first", "last").agg(F.max_by("word", F.struct("wn", "word")).alias("near"))
    known = common.select(F.col("word").alias("last"), F.lit(True).alias("is_word"))
    out = named.join(near.hint("merge"), ["first", "last"], "left").join(usual.hint("merge"), "last", "left").join(known.hint("merge"), "last", "left")
    out = stored(out.select("key", "first", F.when(F.col("is_word"), F.col("last")).otherwise(F.coalesce("near", "usual", "last")).alias("last")), "orgs-full")
    per = out.where("last is not null").groupBy("first").agg(F.count_distinct("last").alias("k"), F.min("last").alias("only"))
    last = F.when(F.col("last").isNotNull(), F.col("last")).when(F.col("k").isNull(), F.lit("")).when(F.col("k") == 1, F.col("only"))
    done = out.join(per.hint("merge"), "first", "left").select("key", F.concat_ws(" ", F.lit("o:"), "first", last).alias("entity"), last.alias("l"))
    return done.where("l is not null").select("key", "entity")


# ---------------------------------------------------------------- result
def entities(pairs: DataFrame) -> DataFrame:
    """``key, entity``: what every record of ``pairs(a, b)`` that can be told means.

    Records without a key or a readable mention have no entity; a record whose e-mails differ
    between rows has all of them.
    """
    rows = stored(records(pairs).mapInPandas(_read, _FORM), "name-forms")
    forms = person_forms(rows.where("not org").drop("org"))
    orgs, words = organisation_forms(rows.where("org and first is not null").select("key", "kind", "first", "last", "whole"))
    said = forms.select("key", F.explode(F.array(F.struct(F.lit("l").alias("kind"), F.col("said").alias("s")), F.struct(F.lit("f").alias("kind"), F.col("first").alias("s")))).alias("x")).select("key", "x.*")
    said = said.where("length(s) > 1").unionByName(orgs.select("key", F.lit("o").alias("kind"), F.col("first").alias("s")))
    used = stored(said.groupBy("kind", "s").agg(F.count_distinct("key").alias("n")), "used-words")
    canon = canonical(used)
    return people(forms, canon).unionByName(organisations(orgs, words, canon)).distinct()


def pairs_of(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``mention_a, mention_b``: all pairs of the members ``key, entity`` of an entity.

    An entity of more than ``block`` members is dealt into blocks by a hash, and each two of
    its blocks meet in a task of their own.
    """
    n = members.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = members.join(n.hint("merge"), "entity").select("key", "entity", blocks.alias("k"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("no"))
    a = dealt.select("entity", F.col("no").alias("i"), F.explode(F.sequence(F.col("no"), F.col("k") - 1)).alias("j"), F.col("key").alias("x"))
    b = dealt.select("entity", F.explode(F.sequence(F.lit(0), F.col("no"))).alias("i"), F.col("no").alias("j"), F.col("key").alias("y"))
    met = a.join(b.hint("merge"), ["entity", "i", "j"]).where("i < j or x < y")
    return met.select(F.least("x", "y").alias("mention_a"), F.greatest("x", "y").alias("mention_b"))


def variants(pairs: DataFrame) -> DataFrame:
    """``mention_a, mention_b``: all pairs of records of ``pairs(a, b)`` that mean the same, distinct."""
    return pairs_of(stored(entities(pairs), "entities"))


def _unreviewed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "phase3_identity_pairs").where(~groups.reviewed())


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Same person or organisation, among the records on unreviewed rows."""
    return variants(_unreviewed(spark, folder))


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """The same as classes: the smallest record of each, its records, and how many it links them to."""
    members = stored(entities(_unreviewed(spark, folder)), "entities")
    per = members.groupBy("entity").agg(F.min("key").alias("class_id"), (F.count(F.lit(1)) - 1).alias("links"))
    return members.join(per.hint("merge"), "entity").select(F.col("key").alias("mention_id"), "class_id", "links")
