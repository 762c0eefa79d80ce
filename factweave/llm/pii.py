"""Problem 5: personal information in free text by bootstrapped contextual extraction.

Known people (authors and participants) and number forms seed a graph of contexts and
instances that is counted over all texts. Spark scores contexts by the known instances they
surround and instances by the contexts they stand in, round after round; contexts and
instances of high confidence then find the names and numbers that no seed held. E-mail
addresses, phone numbers and street addresses have forms of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import pii_patterns as P
from factweave.plans.lineage import stored
from factweave.sources.tables import table

ROUNDS = 3
#: Letters of a lexicon that is broadcast; of a larger one every text gets, by a join, the words it holds.
LEXICON_LETTERS = 32_000_000
#: Counts held by one task before they are passed on.
FLUSH = 100_000

#: An instance is accepted by the share of its occurrences in confident contexts; a word must
#: also stand in several different ones, as a label or a role in brackets does not.
ACCEPTED = "score >= 0.8 and n >= 2 and (kind = 'number' or places >= least(n, 2))"

# Titles, which are no part of a name.
TITLES = set(
    "mr mrs ms miss dr prof professor sir madam herr frau hr hrn m mm mme mlle monsieur madame sr sra srta señor señora"
    " don doña capt captain rev hon mx".split()
)
# Forms of numbers that states issue, with which the search for others begins.
NUMBER_SEEDS = ["999-99-9999", "AA999999A"]

FOUND = "artifact_id string, pii_type string, pii_text string, context string"


# ---------------------------------------------------------------- seeds
def seeds(artifacts: DataFrame) -> DataFrame:
    """``word, role`` (``F`` first name, ``L`` last name) from the people in the metadata.

    Display names are read as ``First [I.] Last``, ``Last, First`` or ``First`` alone, without
    roles in brackets and e-mail addresses. Names of robots (chat ids that begin with ``B``)
    count against their words.
    """
    m = F.col("metadata")
    own = F.struct(F.coalesce(m["author_display_name"], F.col("author")).alias("name"), m["author_user_id"].alias("uid"))
    others = F.transform(F.coalesce(m["participants"], F.array()), lambda p: F.struct(p["display_name"].alias("name"), p["user_id"].alias("uid")))
    people = artifacts.select(F.explode(F.concat(F.array(own), others)).alias("p")).groupBy("p.name", "p.uid").agg(F.count(F.lit(1)).alias("n"))
    robot = F.upper(F.coalesce(F.regexp_replace("uid", r"[\s<>@]", ""), F.lit(""))).startswith("B")
    plain = F.trim(F.regexp_replace(F.regexp_replace("name", r"<[^>]*>?|\S+@\S+", ""), r"\([^)]*\)", ""))
    named = people.select(F.lower(plain).alias("name"), F.when(robot, -F.col("n")).otherwise(F.col("n")).alias("n")).where("name <> ''")
    parts = F.split("name", r"[\s,]+")
    swapped = F.col("name").contains(",")
    last = F.element_at(parts, -1)
    first, second = F.when(swapped, last).otherwise(parts[0]), F.when(swapped, parts[0]).when(F.size(parts) > 1, last)
    both = F.array(F.struct(first.alias("word"), F.lit("F").alias("role")), F.struct(second.alias("word"), F.lit("L").alias("role")))
    words = named.select(F.explode(both).alias("w"), "n").groupBy("w.word", "w.role").agg(F.sum("n").alias("n"))
    fit = words.where("n > 0 and word rlike '^[\\\\p{L}-]{2,}$'").where(~F.col("word").isin(list(TITLES)))
    # A word is used in the role it mostly has; rare ones may have both.
    most = fit.groupBy("word").agg(F.max("n").alias("most"))
    return fit.join(most, "word").where("n * 20 >= most").select("word", "role")


# ---------------------------------------------------------------- evidence
def _known(words: list[str]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {"F": set(), "L": set(), "f": set(), "l": set(), "s": set(), "T": set(), "N": set()}
    for w in words:
        out[w[0]].add(w[2:])
    out["fl"] = out["f"] | out["l"]
    return out


def _forms(text: str, towns: set[str] | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]], list[tuple[str, str]]]:
    """Spans of e-mails, phones and addresses; all taken spans; towns with the word after."""
    found: list[tuple[str, int, int]] = []
    town_words: list[tuple[str, str]] = []
    low = text.lower()
    if "@" in text or "at)" in low or "at]" in low or "at}" in low:
        found += [("email", *m.span()) for m in P.EMAIL.finditer(text)]
    found += [("phone", *span) for span in P.phones(text)]
    for m in P.addresses(text):
        start, end = m.span()
        for group in ("town1", "town2", "town3", "town4", "town5"):
            town = m.group(group)
            if town:
                one, _, two = town.partition(" ")
                town_words.append((one.lower(), two.lower()))
                if two and towns is not None and town.lower() not in towns and m.end(group) == end:
                    end = m.start(group) + len(one)
                elif two and towns is not None and town.lower() not in towns:
                    end = m.start(group) + len(one)
        found.append(("address", start, end))
    return found, [(a, b) for _, a, b in found], town_words


def evidence_of(text: str, firsts: set[str], lasts: set[str]) -> Iterator[tuple[str, str, str]]:
    """``(kind, context, instance)`` of every candidate of a text."""
    _, taken, towns = _forms(text, None)
    for one, two in towns:
        yield "town", one, two
    for a, b in P.capitals(text, taken):
        w = text[a:b].lower()
        if w not in TITLES:
            yield "name", f"{P.before(text, a, firsts, lasts)} _ {P.after(text, b, firsts, lasts)}", w
    for m in P.NUMBER.finditer(text):
        a, b = m.span()
        if not any(x < b and a < y for x, y in taken):
            yield "number", P.number_context(text, a), P.shape(m.group(0))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spoken(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted(P.spoken(t)) if t else [])


def _texts_with(known: DataFrame, texts: DataFrame) -> tuple[DataFrame, object]:
    """The texts with what is known of their words: broadcast if its measured size allows, else joined.

    Either way a text is read by the same functions with the same words at hand.
    """
    spark = texts.sparkSession
    tagged = known.select(F.concat_ws(":", "role", "word").alias("w"))
    if (tagged.agg(F.sum(F.length("w"))).first()[0] or 0) <= LEXICON_LETTERS:
        shared = spark.sparkContext.broadcast([r[0] for r in tagged.toLocalIterator()])
        return texts.withColumn("known", F.lit(None).cast("array<string>")), shared
    # Forms of numbers are few, by the form itself, and go to every text; words meet theirs by a join.
    forms = spark.sparkContext.broadcast([r[0] for r in tagged.where(F.col("w").startswith("N:")).distinct().collect()])
    marked = texts.withColumn("h", F.sha2("content", 256))
    words = marked.where("content is not null").groupBy("h").agg(F.first("content").alias("content")).select("h", F.explode(_spoken("content")).alias("word"))
    hits = words.join(known.hint("merge"), "word").groupBy("h").agg(F.collect_set(F.concat_ws(":", "role", "word")).alias("known"))
    joined = marked.join(hits.hint("merge"), "h", "left")
    return joined.select("artifact_id", "content", F.coalesce("known", F.array().cast("array<string>")).alias("known")), _Forms(forms)


class _Forms:
    """Marks that words come with the text, and holds the forms of numbers."""

    def __init__(self, shared):
        self.forms = shared


def _lexicons(batch: pd.DataFrame, shared, kept: dict) -> Iterator[tuple[str, str, dict]]:
    for artifact, text, known in zip(batch["artifact_id"], batch["content"], batch["known"]):
        if text:
            if not isinstance(shared, _Forms):
                if "all" not in kept:
                    kept["all"] = _known(shared.value)
                yield artifact, text, kept["all"]
            else:
                yield artifact, text, _known([*known, *shared.forms.value])


def evidence(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``kind, context, instance, n`` counted over all of ``texts(artifact_id, content)``."""
    asked, shared = _texts_with(known, texts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        kept: dict = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "context", "instance", "n"])

        for batch in batches:
            for _, text, lex in _lexicons(batch, shared, kept):
                counts.update(evidence_of(text, lex["F"], lex["L"]))
            if len(counts) > FLUSH:
                yield rows()
                counts.clear()
        yield rows()

    made = asked.mapInPandas(count, "kind string, context string, instance string, n long")
    return made.groupBy("kind", "context", "instance").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the graph
def _is(kind: str) -> Column:
    return F.col("kind") == kind


def score(graph: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confident contexts ``(kind, context)`` and scored instances ``(kind, instance, score, n)``.

    ``graph`` as made by ``evidence``; ``known(kind, instance)`` are the seeds. A context of
    names is judged by the share of its different instances that are known and by how many
    there are, one of numbers by the share of its occurrences; an instance by the share of its
    occurrences that stand in confident contexts. What a round accepts the next one builds on.
    """
    edges = graph.where("kind in ('name', 'number')")
    sure = known.select("kind", "instance").distinct().withColumn("seed", F.lit(True))
    good, contexts, scored = sure, None, None
    for no in range(rounds):
        marked = edges.join(good.select("kind", "instance", F.lit(1).alias("ok")), ["kind", "instance"], "left")
        per = marked.groupBy("kind", "context").agg(
            F.count("ok").alias("different"), F.count(F.lit(1)).alias("all"), F.sum(F.when(F.col("ok") == 1, F.col("n"))).alias("n_ok"), F.sum("n").alias("n"),
        )
        names = _is("name") & (F.col("different") >= 3) & (F.col("different") >= 0.75 * F.col("all"))
        numbers = _is("number") & (F.col("n_ok") >= 2) & (F.col("n_ok") >= (0.1 if no == 0 else 0.5) * F.col("n"))
        contexts = per.where(names | numbers).select("kind", "context")
        stood = edges.join(contexts.withColumn("in", F.lit(1)), ["kind", "context"], "left")
        scored = stood.groupBy("kind", "instance").agg(
            (F.coalesce(F.sum(F.when(F.col("in") == 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("score"), F.sum("n").alias("n"),
            F.count_if(F.col("in") == 1).alias("places"),
        )
        fresh = scored.where(ACCEPTED).select("kind", "instance", F.lit(False).alias("seed"))
        good = stored(sure.unionByName(fresh.join(sure, ["kind", "instance"], "left_anti")), "pii-instances")
    return stored(contexts, "pii-contexts"), stored(scored, "pii-scores")


def lexicon(graph: DataFrame, first_last: DataFrame, scored: DataFrame) -> DataFrame:
    """``word, role`` of all that was learned.

    ``F``/``L``: seeds, by which contexts are named. ``f``/``l``: first and last names to look
    for, seeds and discoveries. ``s``: first names that stand for nothing else. ``T``: towns of
    two words. ``N``: forms of numbers.
    """
    names = scored.where(_is("name"))
    old = first_last.select("word", F.lower("role").alias("role"))
    fresh = names.where(ACCEPTED).select(F.col("instance").alias("word"))
    fresh = fresh.join(first_last.select("word").distinct(), "word", "left_anti")
    # A new last name follows a first name or initial now and then, or comes before one; a new
    # first name mostly stands before a last name.
    beside = graph.where(_is("name")).groupBy(F.col("instance").alias("word")).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("context").rlike(r"^(<F>|<I>) _ | _ ,<F>$"), F.col("n"))), F.lit(0)).alias("as_last"),
        F.coalesce(F.sum(F.when(F.col("context").rlike(r" _ (<S>|<I>)$"), F.col("n"))), F.lit(0)).alias("as_first"),
    )
    role = F.when(F.col("as_last") * 10 >= F.col("n"), "l").when(F.col("as_first") * 2 > F.col("n"), "f")
    fresh = fresh.join(beside.select("word", role.alias("role")), "word").where("role is not null")
    solid = names.where("score >= 0.8").select(F.col("instance").alias("word"))
    solid = solid.join(first_last.where("role = 'F'").select("word"), "word", "left_semi").select("word", F.lit("s").alias("role"))
    towns = graph.where(_is("town"))
    of_town = towns.groupBy("context").agg(F.sum("n").alias("all"))
    pairs = towns.where("instance <> ''").join(of_town, "context").where("n * 2 >= all and n >= 2")
    pairs = pairs.select(F.concat_ws(" ", "context", "instance").alias("word"), F.lit("T").alias("role"))
    numbers = scored.where(_is("number")).where(ACCEPTED).select(F.col("instance").alias("word"), F.lit("N").alias("role"))
    return first_last.select("word", "role").unionByName(old).unionByName(fresh).unionByName(solid).unionByName(pairs).unionByName(numbers).distinct()


# ---------------------------------------------------------------- extraction
def names_of(text: str, taken: list[tuple[int, int]], lex: dict) -> Iterator[tuple[int, int, str | None]]:
    """``(start, end, context)`` of names; a context where only it can settle the case."""
    firsts, lasts, solid = lex["f"], lex["l"], lex["s"]
    caps = P.capitals(text, taken)
    words = [text[a:b].lower() for a, b in caps]
    i = 0
    while i < len(caps):
        a, b = caps[i]
        w = words[i]
        first, last = w in firsts, w in lasts
        i += 1
        if not first and not last:
            continue
        nxt = caps[i] if i < len(caps) else None
        gap = text[b : nxt[0]] if nxt and nxt[0] - b <= 5 else None
        if first and gap == " " and words[i] in lasts:
            yield a, nxt[1], None
            i += 1
            continue
        if first and gap and len(gap) == 4 and gap[0] == " " and P.INITIAL.match(gap, 1) and gap[3] == " " and words[i] in lasts:
            yield a, nxt[1], None
            i += 1
            continue
        if last and gap == ", " and words[i] in firsts and not (first and w not in lasts):
            yield a, nxt[1], None
            i += 1
            continue
        if first and text[b : b + 1] == " " and P.INITIAL.match(text, b + 1) and not text[b + 3 : b + 4].isalnum():
            yield a, b + 3, None
            continue
        if a >= 3 and text[a - 1] == " " and P.INITIAL.match(text, a - 3) and (a == 3 or not (text[a - 4].isalnum() or text[a - 4] == ".")) and last:
            yield a - 3, b, None
            continue
        follows = gap == " " and nxt is not None
        if last and not first:
            if not follows or words[i] in firsts or words[i] in lasts:
                yield a, b, None
            continue
        if w in solid and not follows:
            yield a, b, None
        else:
            yield a, b, f"{P.before(text, a, lex['F'], lex['L'])} _ {P.after(text, b, lex['F'], lex['L'])}"
    for w in {x.rstrip(",") for x in text.split()} & lex["fl"]:
        if not w.islower():
            continue
        at = text.find(w)
        while at >= 0:
            end = at + len(w)
            if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "._-@+")) and text[end : end + 1] in (" ", ","):
                comma = text[end] == ","
                start = end + (2 if comma else 1)
                stop = start
                while stop < len(text) and (text[stop].isalpha() or text[stop] == "-"):
                    stop += 1
                other = text[start:stop]
                pair = (w in lasts and other in firsts) if comma else (w in firsts and other in lasts)
                if pair and other.islower() and text[stop : stop + 1] not in ("@", "_") and not any(x < stop and at < y for x, y in taken):
                    yield at, stop, None
            at = text.find(w, end)


def spans_of(text: str, lex: dict) -> Iterator[tuple[str, int, int, str | None]]:
    """``(type, start, end, context)``: everything found, a context where it has to be asked."""
    found, taken, _ = _forms(text, lex["T"])
    for kind, a, b in found:
        yield kind, a, b, None
    for m in P.NUMBER.finditer(text):
        a, b = m.span()
        form = P.shape(m.group(0))
        if (form in lex["N"] or form in NUMBER_SEEDS) and not any(x < b and a < y for x, y in taken):
            yield "id_number", a, b, None if form in NUMBER_SEEDS else P.number_context(text, a)
    for a, b, context in names_of(text, taken, lex):
        yield "person_name", a, b, context


def find(texts: DataFrame, known: DataFrame, contexts: DataFrame) -> DataFrame:
    """``artifact_id, pii_type, pii_text`` of ``texts(artifact_id, content)``, distinct.

    Findings that only their context can settle are kept by a join with the confident ones.
    """
    asked, shared = _texts_with(known, texts)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            rows = []
            for artifact, text, lex in _lexicons(batch, shared, kept):
                rows += {(artifact, kind, text[a:b], context) for kind, a, b, context in spans_of(text, lex)}
            yield pd.DataFrame(rows, columns=["artifact_id", "pii_type", "pii_text", "context"])

    found = asked.mapInPandas(extract, FOUND)
    kind = F.when(F.col("pii_type") == "id_number", "number").otherwise("name")
    sure = contexts.select(F.col("kind").alias("__k"), F.col("context").alias("__c"))
    settled = found.join(sure, (kind == F.col("__k")) & (F.col("context") == F.col("__c")), "left")
    return settled.where("context is null or __c is not null").select("artifact_id", "pii_type", "pii_text").distinct()


def learn(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lexicon and the confident contexts of all of ``artifacts``."""
    texts = artifacts.select(F.col("id").alias("artifact_id"), "content")
    people = stored(seeds(artifacts), "pii-seeds")
    graph = stored(evidence(texts, people), "pii-graph")
    known = people.select(F.lit("name").alias("kind"), F.col("word").alias("instance"))
    forms = artifacts.sparkSession.createDataFrame([("number", s) for s in NUMBER_SEEDS], "kind string, instance string")
    contexts, scored = score(graph, known.unionByName(forms))
    return stored(lexicon(graph, people, scored), "pii-lexicon"), contexts


def personal_information(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, pii_type, pii_text`` of every artifact, verbatim and distinct.

    Null and empty contents give no row; texts of any length are read whole; repeated rows
    count once. Other columns of ``artifacts`` are not read.
    """
    known, contexts = learn(artifacts)
    return find(artifacts.select(F.col("id").alias("artifact_id"), "content"), known, contexts)


# What stands for a finding in the redacted text.
PLACEHOLDERS = {"person_name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]"}


def redacted(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, content``: every different text with its findings replaced by typed placeholders.

    The rest of a text stays as it is. Of findings that overlap, the first and longest stands.
    Texts without findings are passed on unchanged, null contents are left out, and a text that
    was delivered several times comes out once.
    """
    known, contexts = learn(artifacts)
    texts = stored(artifacts.select(F.col("id").alias("artifact_id"), "content").where("content is not null").distinct(), "pii-texts")
    asked, shared = _texts_with(known, texts)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            rows = [(artifact, text, kind, a, b, c) for artifact, text, lex in _lexicons(batch, shared, kept) for kind, a, b, c in spans_of(text, lex)]
            yield pd.DataFrame(rows, columns=["artifact_id", "content", "pii_type", "a", "b", "context"])

    spans = asked.mapInPandas(locate, "artifact_id string, content string, pii_type string, a int, b int, context string")
    spans = spans.withColumn("h", F.sha2("content", 256)).drop("content")
    kind = F.when(F.col("pii_type") == "id_number", "number").otherwise("name")
    sure = contexts.select(F.col("kind").alias("__k"), F.col("context").alias("__c"))
    settled = spans.join(sure, (kind == F.col("__k")) & (F.col("context") == F.col("__c")), "left").where("context is null or __c is not null")
    per = settled.groupBy("artifact_id", "h").agg(F.array_sort(F.collect_set(F.struct("a", (-F.col("b")).alias("b"), "pii_type"))).alias("spans"))
    there = per.select(F.col("artifact_id").alias("__a"), F.col("h").alias("__h"), "spans")
    joined = texts.join(there, F.col("artifact_id").eqNullSafe(F.col("__a")) & (F.sha2("content", 256) == F.col("__h")), "left")

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, found in zip(batch["content"], batch["spans"]):
                parts, at = [], 0
                for x in [] if found is None else found:
                    if x["a"] >= at:
                        parts += [text[at : x["a"]], PLACEHOLDERS[x["pii_type"]]]
                        at = -x["b"]
                out.append("".join(parts) + text[at:])
            yield pd.DataFrame({"artifact_id": batch["artifact_id"], "content": out})

    return joined.select("artifact_id", "content", "spans").mapInPandas(replace, "artifact_id string, content string").distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The contents of all deliveries with placeholders for personal information."""
    return redacted(table(spark, folder, "artifacts"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal information in the contents of all deliveries."""
    return personal_information(table(spark, folder, "artifacts"))
