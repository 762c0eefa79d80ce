"""Entities from signals: keys, canonical entities, bridges from claims, pair candidates, error classes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions.text import mention_key
from factweave.plans.lineage import stored

#: Least likeness, in hundredths, of two spellings that may be one (see ``fuzzy_pairs``).
RATIO = 85


# ---------------------------------------------------------------- keys
def slug(text: Column) -> Column:
    """Letters and digits in lower case joined by dashes; ``unknown`` if there are none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def person_name(raw: Column) -> Column:
    """Display name of ``Name <box@host>``; a bare address in brackets stays an address."""
    bare = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), '^[" ]+|[" ]+$', "")
    name, box = F.regexp_extract(bare, r"^(.*?)\s*<([^<>]+)>\s*$", 1), F.regexp_extract(bare, r"^(.*?)\s*<([^<>]+)>\s*$", 2)
    return F.when(box == "", bare).when(F.regexp_replace(name, '["\\s]', "") == "", F.trim(box)).otherwise(F.regexp_replace(name, '^[" ]+|[" ]+$', ""))


def person_key(mention: Column, email: Column, username: Column) -> Column:
    """``person:`` and the local part of the address, else the user name, else the mention."""
    e, u = F.coalesce(email, F.lit("")), F.coalesce(username, F.lit(""))
    return F.concat(F.lit("person:"), F.when(e.contains("@"), slug(F.split_part(e, F.lit("@"), F.lit(1)))).when(u != "", slug(F.regexp_replace(u, "^@+", ""))).otherwise(slug(mention)))


def account_key(name: Column) -> Column:
    return F.concat(F.lit("account:"), slug(name))


def canonical_key(kind: Column, tokens: Column) -> Column:
    """``type:`` and the sorted tokens joined by dashes."""
    return F.concat(kind, F.lit(":"), F.array_join(F.array_sort(F.array_distinct(tokens)), "-"))


def stable_number(kind: Column, key: Column, kinds: list[str], span: int = 2**48) -> Column:
    """A number from the key in the range of its kind: kinds lie one after another, ``span`` numbers each."""
    at = F.array_position(F.array(*[F.lit(k) for k in kinds]), kind) - 1
    return F.when(at >= 0, at.cast("long") * span + F.pmod(F.xxhash64(key), F.lit(span)))


# ---------------------------------------------------------------- entities
def candidates(artifacts: DataFrame) -> DataFrame:
    """``entity_key, name, mention, email, username, source``: people whom artifacts name as author, participant or ``@user``."""
    m, none = F.col("metadata"), F.lit(None).cast("string")

    def one(mention: Column, email: Column, user: Column) -> Column:
        return F.struct(mention.alias("mention"), email.alias("email"), user.alias("username"))

    inside = F.transform(F.coalesce(m["participants"], F.array()), lambda p: one(person_name(p["display_name"]), p["email"], p["username"]))
    own = F.array(one(person_name(F.coalesce(m["author_display_name"], F.col("author"))), F.nullif(F.lower(F.regexp_extract(F.coalesce("author", F.lit("")), r"[\w.+-]+@[\w-]+\.[\w.-]+", 0)), F.lit("")), none))
    said = F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?<![\w.<])@([A-Za-z0-9_.-]+)"), F.lit(1)), lambda u: one(F.concat(F.lit("@"), u), none, F.concat(F.lit("@"), u)))
    rows = artifacts.select("source", F.explode(F.concat(own, inside, said)).alias("c")).select("source", "c.*").where("mention is not null and mention <> ''")
    return rows.select(person_key(F.col("mention"), F.col("email"), F.col("username")).alias("entity_key"), F.col("mention").alias("name"), "mention", "email", "username", "source")


def merged(found: DataFrame) -> DataFrame:
    """One canonical entity per key: the sets of all that its candidates bring, and the most used name."""
    counts = found.groupBy("entity_key", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("entity_key").agg(F.max_by("name", F.struct("n", "name")).alias("name"))
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("mention", "email", "username", "source")]
    return found.groupBy("entity_key").agg(*sets, F.count(F.lit(1)).alias("members")).join(counts, "entity_key")


def resolutions(entities: DataFrame) -> DataFrame:
    """``entity_key, name, label, mentions, aliases``: what claims are resolved with; mentions include addresses and user names."""
    label = F.initcap(F.split_part("entity_key", F.lit(":"), F.lit(1)))
    every = F.array_sort(F.array_distinct(F.concat("mentions", "emails", "usernames")))
    return entities.select("entity_key", "name", label.alias("label"), every.alias("mentions"), F.array_sort(F.array_except("mentions", F.array("name"))).alias("aliases"))


def lookup(resolved: DataFrame) -> DataFrame:
    """``mention, entity_key, entities``: every mention by key, with how many entities it may mean; the first one stands."""
    rows = resolved.select("entity_key", F.explode(F.array_distinct(F.concat(F.array("name"), "mentions"))).alias("m")).select(mention_key(F.col("m")).alias("mention"), "entity_key").where("mention <> ''")
    return rows.groupBy("mention").agg(F.min("entity_key").alias("entity_key"), F.count_distinct("entity_key").alias("entities"))


def bridged(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``subject_entity, object_entity`` and ``resolution_status``: resolved, review (one side) or unresolved."""
    out = claims
    for side in ("subject", "object"):
        known = names.where("entities = 1").select(F.col("mention").alias(f"__{side}"), F.col("entity_key").alias(f"{side}_entity"))
        out = out.join(known, mention_key(F.col(f"{side}_mention")) == F.col(f"__{side}"), "left").drop(f"__{side}")
    both = F.col("subject_entity").isNotNull().cast("int") + F.col("object_entity").isNotNull().cast("int")
    return out.withColumn("resolution_status", F.when(both == 2, "resolved").when(both == 1, "review").otherwise("unresolved"))


def bridge_summary(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    counts = [F.count_if(F.col("resolution_status") == s).alias(s) for s in ("resolved", "review", "unresolved")]
    return rows.agg(n.alias("claims"), *counts, F.coalesce(F.round(F.count_if(F.col("resolution_status") == "resolved") / n, 4), F.lit(0.0)).alias("resolve_rate"))


def resolved_claims(claims: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims whose two mentions each mean one entity, and ``mention, entities`` of those that mean none or several."""
    b = bridged(claims, names)
    said = claims.select(F.explode(F.array(mention_key(F.col("subject_mention")), mention_key(F.col("object_mention")))).alias("mention")).distinct()
    wrong = said.join(names, "mention", "left").where("entities is null or entities > 1").select("mention", F.coalesce("entities", F.lit(0)).alias("entities"))
    return b.where("resolution_status = 'resolved'"), wrong


def bound_artifacts(claims: DataFrame, fixtures: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``bound``: ``fixture`` if the artifact is one, else ``stored`` if it was loaded before, else null (an error for the loader)."""
    a = fixtures.select(F.col("id").alias("__f")).distinct()
    b = stored.select(F.col("id").alias("__s")).distinct()
    met = claims.join(a, F.col("artifact_id") == F.col("__f"), "left").join(b, F.col("artifact_id") == F.col("__s"), "left")
    return met.withColumn("bound", F.when(F.col("__f").isNotNull(), "fixture").when(F.col("__s").isNotNull(), "stored")).drop("__f", "__s")


def latest(batches: DataFrame, key: str, batch: str) -> DataFrame:
    """Of rows of the same key over several batches, those of the last one stand."""
    row = F.struct(*[c for c in batches.columns if c != key])
    return batches.groupBy(key).agg(F.max_by(row, F.struct(batch, F.to_json(row))).alias("r")).select(key, "r.*")


def gap_filled(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``more`` whose keys it lacks, each key of those once."""
    order = F.to_json(F.struct(*more.columns))
    new = more.join(base.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.min_by(F.struct(*more.columns), order).alias("r")).select("r.*")
    return base.unionByName(new)


# ---------------------------------------------------------------- pairs
def _paired(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    met = left.select("k", F.col("norm").alias("x")).join(right.select("k", F.col("norm").alias("y")).hint("merge"), "k").where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(how).alias("how"))


def pair_candidates(entries: DataFrame) -> DataFrame:
    """``a, b, how``: pairs of ``entries(norm, type, overlaps)`` that may be one, each with the first rule that made it.

    Rules: an entry names the other among its ``overlaps``; a first name alone and a full name
    that begins with it; a name and the local part of an address; two full names of the same
    first name, next to each other in the order of a hash (hard cases, one partner each).
    Every rule is an equality join on a derived key.
    """
    e = entries.where("norm is not null and norm <> ''").groupBy("norm", "type").agg(F.flatten(F.collect_set(F.coalesce("overlaps", F.array().cast("array<string>")))).alias("overlaps"))
    person, mail = e.where("type = 'person'"), e.where("type = 'email'")
    words = F.split("norm", r"\s+")
    known = person.unionByName(mail)
    full = person.where(F.size(words) >= 2).withColumn("k", words[0])
    dotted = lambda d: d.withColumn("k", F.regexp_replace(F.split_part("norm", F.lit("@"), F.lit(1)), "[_ -]", "."))
    turn = full.withColumn("h", F.xxhash64("norm", "k"))
    from pyspark.sql import Window

    nos = turn.withColumn("no", F.row_number().over(Window.partitionBy("k", F.pmod("h", F.lit(16))).orderBy("h", "norm"))).withColumn("k", F.concat_ws("|", "k", F.pmod("h", F.lit(16)), F.floor((F.col("no") - 1) / 2)))
    rules = [
        _paired(known.select("norm", F.explode("overlaps").alias("k")), known.select("norm", F.col("norm").alias("k")), "1-cross-source-overlap"),
        _paired(person.where(F.size(words) == 1).withColumn("k", F.col("norm")), full, "2-first-name-vs-full-name"),
        _paired(dotted(person), dotted(mail), "3-name-vs-email-local-part"),
        _paired(nos, nos, "4-same-first-name"),
    ]
    every = rules[0]
    for r in rules[1:]:
        every = every.unionByName(r)
    return every.groupBy("a", "b").agg(F.min("how").alias("how"))


def _following(most: int):
    """Of rows sorted by ``how, k`` and the largest ``norm`` first: to each the next ``most`` entries of its group that make a pair by that rule and by none before it.

    Entries that any other one meets or misses alike are one class, of which the last ``most`` are
    kept; classes of people whose words hold the group's key lie together, as they all share it.
    """

    def fits(how: str, a: tuple, b: tuple) -> bool:
        (role, person, slot, words), (role_b, person_b, slot_b, words_b) = a, b
        mailbox = slot == slot_b and ((role and person_b) or (person and role_b))
        if how == "role-mailbox":
            return mailbox
        return not mailbox and not (how == "ticket" and person and person_b and not words.isdisjoint(words_b))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, kept, no = None, deque(maxlen=2 * most), {}, 0
        for batch in batches:
            out = []
            for how, k, norm, role, person, slot, said in zip(*(batch[c].tolist() for c in ("how", "k", "norm", "role", "person", "slot", "words"))):
                if (how, k) != now:
                    now, kept = (how, k), {}
                    last.clear()
                words = frozenset(said) if how == "ticket" and person else frozenset()
                own, no = (role, person, slot, words), no + 1
                near = [x for x in last if fits(how, own, x[2])]
                if len(near) < most and len(last) == last.maxlen:
                    near = [(n, b, c) for part, classes in kept.items() if part not in words for c, rows in classes.items() if fits(how, own, c) for n, b in rows]
                out += [(norm, b, how) for _, b, _ in sorted(near, reverse=True, key=lambda x: x[0])[:most]]
                last.append((no, norm, own))
                part = min((w for w in words if k in w), default=None)
                kept.setdefault(part, {}).setdefault(own, deque(maxlen=most)).append((no, norm))
            yield pd.DataFrame(out, columns=["a", "b", "how"], dtype=object)

    return found


def hard_pairs(entries: DataFrame, per_entry: int = 3) -> DataFrame:
    """``a, b, how``: cases that are easily decided wrongly, of ``entries(norm, type, tickets, role)``.

    A mailbox of a role and people of the same of 64 hashes, two names that stand with the same
    ticket, two names with a word in common; a pair has the first such rule by its name.
    ``per_entry`` bounds how many partners after it in the order of names an entry is shown with
    per rule, as a reviewer's list does; it is no limit of what may be the same. Groups are read
    once in their order, so the work grows with their entries and not with their pairs.
    """
    none = F.array().cast("array<string>")
    known = F.coalesce(F.bool_or("role"), F.lit(False)), F.coalesce(F.bool_or(F.col("type") == "person"), F.lit(False))
    e = entries.where("norm is not null and norm <> ''").groupBy("norm").agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tickets", none)))).alias("tickets"), known[0].alias("role"), known[1].alias("person"))
    e = e.withColumn("slot", F.pmod(F.xxhash64("norm"), F.lit(64)).cast("int")).withColumn("words", F.when(F.col("person"), F.filter(F.array_distinct(F.split("norm", r"\s+")), lambda w: F.length(w) > 1)).otherwise(none))
    group = lambda how, k: F.struct(F.lit(how).alias("how"), k.alias("k"))
    slots = F.when(F.col("role") | F.col("person"), F.array(group("role-mailbox", F.col("slot").cast("string")))).otherwise(F.array())
    groups = F.concat(slots, F.transform("words", lambda w: group("shared-word", w)), F.transform(F.array_compact("tickets"), lambda t: group("ticket", t)))
    rows = e.withColumn("g", F.explode(groups)).select("g.*", "norm", "role", "person", "slot", F.when(F.col("g.how") == "ticket", F.col("words")).otherwise(none).alias("words"))
    near = rows.repartition("how", "k").sortWithinPartitions("how", "k", F.desc("norm")).mapInPandas(_following(per_entry), "a string, b string, how string")
    first = near.groupBy("a", "how").agg(F.slice(F.array_sort(F.collect_set("b")), 1, per_entry).alias("b"))
    return first.select("a", F.explode("b").alias("b"), "how")


def entity(entities: DataFrame, key: str) -> DataFrame:
    """One entity by its key, with what it is called and where it was met."""
    return entities.where(F.col("entity_key") == key)


def evidence_of(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """``entity_key, claims, artifacts`` of every entity by its mentions; entities without claims have zeros."""
    names = entities.select("entity_key", F.explode("mentions").alias("m")).select("entity_key", mention_key(F.col("m")).alias("k")).distinct()
    said = claims.select("claim_id", "artifact_id", F.explode(F.array_distinct(F.array(mention_key(F.col("subject_mention")), mention_key(F.col("object_mention"))))).alias("k"))
    per = names.join(said.hint("merge"), "k").groupBy("entity_key").agg(F.count_distinct("claim_id").alias("claims"), F.count_distinct("artifact_id").alias("artifacts"))
    return entities.select("entity_key").distinct().join(per, "entity_key", "left").na.fill(0, ["claims", "artifacts"])


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of a number."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts in hundredths: twice the common subsequence of their sorted words by both lengths."""

    def one(x, y):
        if x is None or y is None:
            return None
        x, y = (" ".join(sorted(t.split())) for t in (x, y))
        return 100.0 * 2 * _lcs(x, y) / (len(x) + len(y)) if x or y else 100.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def hash_text(g: str) -> int:
    import zlib

    return zlib.crc32(g.encode())


#: Texts of one length, and letters of them, that one task holds against as many others; pairs whose letters are compared at a time.
BLOCK, LETTERS, AT_ONCE = 16_384, 1 << 22, 1 << 15


def _sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def _signature(text: str) -> int:
    """Two bits for each of 32 classes of letters: whether the text has one, and two. A letter more or less changes one bit at most."""
    once = twice = 0
    for c in text:
        bit = 1 << (ord(c) & 31)
        twice |= once & bit
        once |= bit
    return (once | twice << 32) - (twice >> 31 << 64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [_sorted_words(x) for x in batch["norm"]]
        yield pd.DataFrame({"type": batch["type"], "norm": batch["norm"], "n": [len(t) for t in texts], "sig": np.array([_signature(t) for t in texts], dtype=np.int64)})


def _letters(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts of one size, a row each, and how many of each of 32 classes they have."""
    codes = np.array(texts, dtype=f"U{size}").view(np.uint32).reshape(len(texts), size)
    return codes, np.stack([((codes & 31) == c).sum(axis=1) for c in range(32)], axis=1).astype(np.int32)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``_lcs`` of the rows of two tables of code points; of many pairs at once, if a row of ``x`` fits the bits of a number."""
    if x.shape[1] > 64:
        return np.array([_lcs("".join(map(chr, a)), "".join(map(chr, b))) for a, b in zip(x.tolist(), y.tolist())], dtype=np.int64)
    row = np.full(len(x), 2**64 - 1, dtype=np.uint64)
    bits = np.zeros((len(x), 8), dtype=np.uint8)
    for c in range(y.shape[1]):
        packed = np.packbits(x == y[:, c, None], axis=1, bitorder="little")
        bits[:, : packed.shape[1]] = packed
        u = row & bits.view(np.uint64)[:, 0]
        row = (row + u) | (row - u)
    kept = row & np.uint64((1 << x.shape[1]) - 1)
    return x.shape[1] - np.bitwise_count(kept).astype(np.int64)


def _alike(ratio: int, same: bool, la: int, lb: int, left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple]:
    """``a, b, ratio`` of two blocks of texts of the lengths ``la <= lb``; ``same``: both are one block."""
    names, other = left["norm"].to_numpy(dtype=object), right["norm"].to_numpy(dtype=object)
    sa, sb = (d["sig"].to_numpy(dtype=np.int64).view(np.uint64) for d in (left, right))
    most = int((100 - ratio) * (la + lb) // 100)
    (xa, ha), (xb, hb) = (_letters([_sorted_words(t) for t in d], n) for d, n in ((names, la), (other, lb)))
    wide = max(1, (1 << 22) // max(len(sb), 1))
    for at in range(0, len(sa), wide):
        i, j = np.nonzero(np.bitwise_count(sa[at : at + wide, None] ^ sb[None, :]) <= most)
        for k in range(0, len(i), AT_ONCE):
            x, y = i[k : k + AT_ONCE] + at, j[k : k + AT_ONCE]
            near = np.abs(ha[x] - hb[y]).sum(axis=1) <= most
            if same:
                near &= names[x] < other[y]
            x, y = x[near], y[near]
            like = 100.0 * 2 * _common(xa[x], xb[y]) / (la + lb)
            for p, q, r in zip(names[x[like >= ratio]], other[y[like >= ratio]], like[like >= ratio].tolist()):
                yield min(p, q), max(p, q), r


def _runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each key of sorted batches, however these cut them."""
    now, held = None, []
    for batch in batches:
        starts = np.flatnonzero((batch[key] != batch[key].shift()).any(axis=1).to_numpy()).tolist()
        for i, j in zip(starts, starts[1:] + [len(batch)]):
            part = batch.iloc[i:j]
            k = tuple(part[key].iloc[0].tolist())
            if k != now and held:
                yield now, pd.concat(held)
                held = []
            now = k
            held.append(part)
    if held:
        yield now, pd.concat(held)


def fuzzy_pairs(entries: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``type, a, b, ratio``: all pairs of different texts ``norm`` of a type at least ``ratio`` like each other.

    Texts of each two lengths that can be so alike meet in blocks. There a number per text, from
    which a pair's least distance is read, leaves few pairs, their counts of letters fewer, and
    the rest is decided by the common subsequence; no pair is lost.
    """
    e = entries.where("type is not null and norm is not null and norm <> ''").select("type", "norm").distinct()
    rows = stored(e.mapInPandas(_signed, "type string, norm string, n int, sig long").where("n > 0"), "signed-texts")
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(LETTERS) / F.col("n"))))
    cells = rows.groupBy("type", "n").agg(F.count(F.lit(1)).alias("k")).withColumn("k", F.ceil(F.col("k") / most).cast("int"))
    half = lambda x: cells.select("type", F.col("n").alias(f"l{x}"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias(f"s{x}"))
    once = (F.col("l1") < F.col("l2")) | ((F.col("l1") == F.col("l2")) & (F.col("s1") <= F.col("s2")))
    tasks = half(1).join(half(2).hint("merge"), "type").where(once & ((F.col("l2") - F.col("l1")) * 100 <= (100 - ratio) * (F.col("l1") + F.col("l2"))))
    dealt = rows.join(cells.hint("merge"), ["type", "n"]).withColumn("no", F.pmod(F.xxhash64("norm"), F.col("k")).cast("int")).drop("k")
    key = ["type", "l1", "s1", "l2", "s2"]
    sides = [dealt.withColumnsRenamed({"n": f"l{x}", "no": f"s{x}"}).join(tasks.hint("merge"), ["type", f"l{x}", f"s{x}"]).select(*key, F.lit(x).alias("side"), "norm", "sig") for x in (1, 2)]
    together = sides[0].unionByName(sides[1]).repartition(*key).sortWithinPartitions(*key)

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (kind, la, sa, lb, sb), rows_ in _runs(batches, key):
            left, right = (rows_[rows_["side"] == x] for x in (1, 2))
            found = list(_alike(ratio, (la, sa) == (lb, sb), la, lb, left, right))
            if found:
                yield pd.DataFrame([(kind, *x) for x in found], columns=["type", "a", "b", "ratio"])

    return together.mapInPandas(met, "type string, a string, b string, ratio double")


# ---------------------------------------------------------------- features and errors
def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; null if both are empty."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    """Product of two unit vectors, within -1 and 1; null if they differ in length."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product)))


def contexts(mentions: DataFrame) -> DataFrame:
    """``mention, artifacts, projects, channels`` of ``mentions(mention, artifact_id, project, channel)`` as sorted sets."""
    sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("artifact_id", "artifacts"), ("project", "projects"), ("channel", "channels"))]
    return mentions.groupBy("mention").agg(*sets)


def context_features(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``cooccurrence, shared_project, shared_channel`` to ``pairs(a, b)`` of mentions; null without evidence on both sides."""
    one = known.select(F.col("mention").alias("a"), F.struct("artifacts", "projects", "channels").alias("xa"))
    two = known.select(F.col("mention").alias("b"), F.struct("artifacts", "projects", "channels").alias("xb"))
    met = pairs.join(one, "a", "left").join(two, "b", "left")

    def shared(f: str) -> Column:
        x, y = F.col(f"xa.{f}"), F.col(f"xb.{f}")
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.arrays_overlap(x, y).cast("double"))

    return met.select(*pairs.columns, F.round(jaccard(F.col("xa.artifacts"), F.col("xb.artifacts")), 6).alias("cooccurrence"), shared("projects").alias("shared_project"), shared("channels").alias("shared_channel"))


def boosted(score: Column, same_source: Column, embedding: Column, cooccurrence: Column) -> Column:
    """A score with evidence that alone never merges: the same source lifts a weak one, likeness of meaning or company into review."""
    first = F.when(F.coalesce(same_source == 1, F.lit(False)) & (score > 0) & (score < 0.6), F.least(score + 0.05, F.lit(0.6))).otherwise(score)
    e, c = F.coalesce(embedding, F.lit(0.0)), F.coalesce(cooccurrence, F.lit(0.0))
    lifted = F.when((e >= 0.9) | (c >= 0.9), F.greatest(first, F.lit(0.8))).when(((e >= 0.8) | (c >= 0.8)) & (first < 0.6), F.lit(0.6)).otherwise(first)
    return F.when(first > 0, lifted).otherwise(first)


def error_class(gold: Column, decision: Column, signals: Column, similarity: Column, role: Column) -> Column:
    """Why a pair was decided wrongly, by the mechanism that misled; null if it was right.

    (Elsewhere any likeness at all counts as initials; here it takes a half.)
    """
    has = lambda s: F.array_contains(signals, s)
    like = F.coalesce(similarity, F.lit(0.0))
    split = (
        F.when(has("username"), "FALSE_SPLIT_USERNAME").when(has("email-username") | has("email-local-part"), "FALSE_SPLIT_ALIAS").when(has("external-id"), "FALSE_SPLIT_CROSS_SOURCE_ID")
        .when(like >= 0.5, "FALSE_SPLIT_INITIALS").otherwise("FALSE_SPLIT_ALIAS")
    )
    merge = F.when(role, "FALSE_MERGE_ROLE_MAILBOX").when(has("email-local-part"), "FALSE_MERGE_EMAIL").when(like < 0.5, "FALSE_MERGE_TOKEN_OVERLAP").otherwise("FALSE_MERGE_NAME")
    different = F.when(decision == "KEEP_SEPARATE", None).when(decision == "MERGE", merge).when(decision == "REVIEW", "REVIEW_AMBIGUOUS").otherwise("ABSTAIN_INSUFFICIENT_EVIDENCE")
    uncertain = F.when(decision.isin("REVIEW", "ABSTAIN"), None).when(decision == "MERGE", "FALSE_MERGE_NAME").otherwise("FALSE_SPLIT_ALIAS")
    return F.when((gold == "SAME_ENTITY") & (decision != "MERGE"), split).when(gold == "DIFFERENT_ENTITY", different).when(gold == "UNCERTAIN", uncertain)
