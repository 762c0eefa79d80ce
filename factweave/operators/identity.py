"""Entity resolution: guarded features, the score ladder, pair decisions, blocking, clusters, evaluation.

Sides are structs ``mention, type, emails, external_ids``. A feature is 1, 0 or null where
there is no evidence on both sides. Everything is built from array functions in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.plans.lineage import cut

# Functional mailboxes, which are no evidence of a person.
ROLE_MAILBOXES = [
    "procurement", "procure", "support", "security", "billing", "legal", "accounts", "accounting", "marketing", "sales", "it", "helpdesk",
    "no-reply", "noreply", "info", "admin", "ops", "marketplace-ops", "marketplace", "finance", "hr", "payments", "dev-null", "oncall",
]
# A role in brackets at the end of a mention, and the shape of an e-mail address.
ROLE_SUFFIX = r"\s*\((?:[a-z]+\s+)?(?:ae|se|csm|pm|sre|devops|security|product|eng(?:ineering)?|ops|cto|legal)\)\s*$"
EMAIL = r"^[^@\s]+@[^@\s]+$"
# Scores of the ladder, thresholds of the decision.
EMAIL_SCORE, EMAIL_USER_SCORE, ID_SCORE, USER_SCORE, FULL_SCORE, TOKENS_SCORE, TOKEN_SCORE = 0.97, 0.92, 0.90, 0.88, 0.85, 0.80, 0.55
MERGE, REVIEW = 0.90, 0.50
#: Records of one blocking key that are held against each other in one place.
BLOCK = 500


def _sorted_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(a)))


def local_part(email: Column) -> Column:
    """Local part with separators as dots."""
    return F.regexp_replace(F.lower(F.split_part(email, F.lit("@"), F.lit(1))), r"[^a-z0-9]+", ".")


def is_role(email: Column) -> Column:
    local = local_part(email)
    return F.regexp_replace(local, r"\.", "-").isin(ROLE_MAILBOXES) | F.split_part(local, F.lit("."), F.lit(1)).isin(ROLE_MAILBOXES)


def emails(side: str) -> Column:
    """Well-formed addresses of a side, lower case, sorted, role mailboxes included."""
    clean = F.transform(F.coalesce(F.col(f"{side}.emails"), F.array().cast("array<string>")), lambda e: F.lower(F.trim(e)))
    return _sorted_set(F.filter(clean, lambda e: e.rlike(EMAIL)))


def name_tokens(mention: Column) -> Column:
    """Name tokens: an address gives those of its local part, a role mailbox none, a role in brackets is dropped."""
    m = F.lower(F.trim(F.coalesce(mention, F.lit(""))))
    text = F.when(m.rlike(EMAIL) & is_role(m), "").when(m.rlike(EMAIL), F.split_part(m, F.lit("@"), F.lit(1))).otherwise(F.regexp_replace(m, ROLE_SUFFIX, ""))
    return F.array_remove(_sorted_set(F.split(text, "[^a-z0-9]+")), "")


def usernames(side: str) -> Column:
    """The mention of a side of type ``username``, without ``@``."""
    u = F.lower(F.regexp_replace(F.trim(F.col(f"{side}.mention")), "^@", ""))
    return F.when(F.lower(F.col(f"{side}.type")) == "username", F.array(u)).otherwise(F.array().cast("array<string>"))


def _evidence(a: Column, b: Column) -> Column:
    """1 if two arrays share something, 0 if both hold something, else null."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), None).when(F.arrays_overlap(a, b), 1.0).otherwise(0.0)


def _base(user: Column) -> Column:
    return F.split_part(F.regexp_replace(user, "[_.]", "-"), F.lit("-"), F.lit(1))


def _undotted(a: Column) -> Column:
    return F.transform(a, lambda x: F.regexp_replace(x, r"\.", ""))


def features(pairs: DataFrame) -> DataFrame:
    """Adds tokens and features to ``pairs(pair_id, a, b)``.

    An address of one side is held against a user name of the other only, so one record's own
    address and user name are no evidence.
    """
    for s in "ab":
        pairs = pairs.withColumns({f"{s}_emails": emails(s), f"{s}_tokens": name_tokens(F.col(f"{s}.mention")), f"{s}_users": usernames(s)})
        pairs = pairs.withColumn(f"{s}_locals", _sorted_set(F.transform(F.filter(f"{s}_emails", lambda e: ~is_role(e)), local_part)))
        pairs = pairs.withColumn(f"{s}_domains", _sorted_set(F.transform(f"{s}_emails", lambda e: F.split_part(e, F.lit("@"), F.lit(-1)))))
        ids = F.transform(F.coalesce(F.col(f"{s}.external_ids"), F.array().cast("array<string>")), lambda x: F.lower(x))
        pairs = pairs.withColumn(f"{s}_ids", _sorted_set(F.filter(ids, lambda x: ~x.startswith("mention:"))))
    local = _evidence(F.col("a_locals"), F.col("b_locals"))
    domain = F.arrays_overlap("a_domains", "b_domains")

    def crosses(x: str, y: str) -> Column:
        users = F.concat(_undotted(F.col(f"{y}_users")), F.transform(f"{y}_users", _base))
        return _evidence(_undotted(F.col(f"{x}_locals")), users)

    cross = F.greatest(crosses("a", "b"), crosses("b", "a"))
    shared = F.filter(
        "a_tokens",
        lambda t: F.array_contains("b_tokens", t)
        | ((F.length(t) == 1) & F.exists("b_tokens", lambda o: o.startswith(t)))
        | F.exists("b_tokens", lambda o: (F.length(o) == 1) & t.startswith(o)),
    )
    out = pairs.withColumns({
        "email_match": F.when(local == 1, F.when(domain, 1.0).otherwise(0.0)).otherwise(local),
        "email_username_match": cross,
        "external_id_match": _evidence(F.col("a_ids"), F.col("b_ids")),
        "username_match": _evidence(F.transform("a_users", _base), F.transform("b_users", _base)),
        "shared": F.size(shared),
    })
    union = F.size(F.array_union("a_tokens", "b_tokens"))
    blank = (F.size("a_tokens") == 0) | (F.size("b_tokens") == 0)
    same = F.col("a_tokens") == F.col("b_tokens")
    return out.withColumn("name_similarity", F.when(blank, None).when(same, 1.0).otherwise(F.col("shared") / union))


def scored(pairs: DataFrame) -> DataFrame:
    """Adds ``score`` by the first evidence that applies, and ``signals``."""
    f = features(pairs)

    def hit(name: str) -> Column:
        return F.coalesce(F.col(name) == 1, F.lit(False))

    na, nb, k = F.size("a_tokens"), F.size("b_tokens"), F.col("shared")
    score = (
        F.when(hit("email_match"), EMAIL_SCORE).when(hit("email_username_match"), EMAIL_USER_SCORE).when(hit("external_id_match"), ID_SCORE).when(hit("username_match"), USER_SCORE)
        .when((k > 0) & (na == k) & (nb == k), FULL_SCORE).when(k >= 2, TOKENS_SCORE).when(k == 1, TOKEN_SCORE).otherwise(0.0)
    )
    signals = F.array_compact(F.array(
        F.when(hit("email_match"), "email-local-part"), F.when(hit("email_username_match"), "email-username"), F.when(hit("external_id_match"), "external-id"), F.when(hit("username_match"), "username"),
    ))
    return f.withColumns({"score": score, "signals": signals})


def decided(pairs: DataFrame, merge: float | Column = MERGE) -> DataFrame:
    """Adds ``decision``: MERGE, KEEP_SEPARATE, REVIEW or ABSTAIN, the first rule that applies."""
    s = scored(pairs)
    role = F.exists("a_emails", is_role) | F.exists("b_emails", is_role)

    def words(side: str) -> Column:
        m = F.regexp_replace(F.lower(F.trim(F.col(f"{side}.mention"))), ROLE_SUFFIX, "")
        return F.array_remove(F.split(m, "[^a-z0-9]+"), "")

    a, b = words("a"), words("b")
    both = (F.size(a) >= 2) & (F.size(b) >= 2)
    fa, fb = F.try_element_at(a, F.lit(1)), F.try_element_at(b, F.lit(1))
    firsts = (fa == fb) | ((F.length(fa) == 1) & fb.startswith(fa)) | ((F.length(fb) == 1) & fa.startswith(fb))
    different = (F.try_element_at(a, F.lit(-1)) != F.try_element_at(b, F.lit(-1))) | ~firsts
    decision = (
        F.when(F.col("score") >= merge, "MERGE").when(role, "KEEP_SEPARATE").when(both & (F.size("signals") == 0) & different, "KEEP_SEPARATE")
        .when((F.col("score") <= 0.2) & both & ~F.arrays_overlap(a, b), "KEEP_SEPARATE").when(F.col("score") >= REVIEW, "REVIEW").otherwise("ABSTAIN")
    )
    return s.withColumn("decision", decision)


def gold(label: Column) -> Column:
    """``SAME_ENTITY``, ``DIFFERENT_ENTITY`` or ``UNCERTAIN``; null for unreviewed pairs."""
    u = F.regexp_replace(F.upper(F.trim(label)), "[^A-Z]+", "_")
    return F.when(u.isin("SAME", "SAME_ENTITY"), "SAME_ENTITY").when(u.isin("DIFFERENT", "DIFFERENT_ENTITY"), "DIFFERENT_ENTITY").when(u == "UNCERTAIN", "UNCERTAIN")


def evaluated(pairs: DataFrame) -> DataFrame:
    """One row of counts and rates of decided pairs ``(decision, gold)``."""
    merged, same = F.col("decision") == "MERGE", F.col("gold") == "SAME_ENTITY"
    split, other = F.col("decision") == "KEEP_SEPARATE", F.col("gold") == "DIFFERENT_ENTITY"
    right = (same & merged) | (other & split) | ((F.col("gold") == "UNCERTAIN") & F.col("decision").isin("REVIEW", "ABSTAIN"))
    return pairs.where("gold is not null").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(right).alias("correct"), F.count_if(merged & other).alias("false_merges"), F.count_if(split & same).alias("false_splits"),
        F.count_if(merged & same).alias("true_merges"), F.count_if(merged).alias("merges"), F.count_if(same).alias("same"), F.count_if(F.col("decision") == "REVIEW").alias("reviews"),
        F.count_if(F.col("decision") == "ABSTAIN").alias("abstentions"),
    )


def blocked(records: DataFrame) -> DataFrame:
    """``key_a, key_b, shared_keys``: candidate pairs of ``records`` with a key in common (see ``blocking_keys``).

    Equal key lists are first reduced to one representative record, so exact copies are not
    spread into pairs; the pairs stand between representatives (see ``representatives`` for the
    membership). The records of a key are dealt into blocks of about ``BLOCK`` and every two
    blocks meet on their own, so a name that many bear ends in no single task. A pair is taken
    at the least of the keys it shares, so pairs are neither repeated nor shuffled.
    """
    reps = representatives(records).dropDuplicates(["rep"]).select("rep", F.transform("keys", lambda k: F.xxhash64(k)).alias("keys"))
    keyed = cut(reps).select("rep", "keys", F.explode("keys").alias("k"))
    often = keyed.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = keyed.join(often.where("blocks > 1"), "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, every = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("k", own.alias("i"), every.alias("j"), F.col("rep").alias("key_a"), F.col("keys").alias("keys_a"))
    right = dealt.select("k", every.alias("i"), own.alias("j"), F.col("rep").alias("key_b"), F.col("keys").alias("keys_b"))
    met = left.join(right, ["k", "i", "j"]).where("key_a < key_b").withColumn("shared", F.array_intersect("keys_a", "keys_b"))
    return met.where(F.col("k") == F.array_min("shared")).select("key_a", "key_b", F.size("shared").cast("long").alias("shared_keys"))


def blocking_keys() -> Column:
    """Keys of ``records(mention, type, emails, external_ids)``: everything that two records of one entity may share.

    Address, local part, user name and its base, external id (not that of the mention, which is
    the record), each name token, the full name, and the form without dots in which a local
    part meets a user name. A mention that is an address counts as one; role mailboxes do not.
    """
    none = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(c, none), lambda x: F.lower(F.trim(x)))
    boxes = F.filter(low(F.concat(F.coalesce("emails", none), F.array("mention"))), lambda e: e.rlike(EMAIL) & ~is_role(e))
    locals_ = F.transform(boxes, local_part)
    user = F.lower(F.regexp_replace(F.trim("mention"), "^@", ""))
    users = F.when(F.lower("type") == "username", F.array(user)).otherwise(none)
    ids = F.filter(low(F.col("external_ids")), lambda x: (x != "") & ~x.startswith("mention:"))
    t = name_tokens(F.col("mention"))
    names = F.when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(none)
    bases = F.filter(F.transform(users, _base), lambda u: u != "")
    kinds = {"e": boxes, "l": locals_, "u": users, "b": bases, "x": ids, "t": t, "n": names, "c": F.concat(_undotted(locals_), _undotted(users), bases)}
    return _sorted_set(F.concat(*[F.transform(c, lambda x, p=p: F.concat(F.lit(f"{p}:"), x)) for p, c in kinds.items()]))


def representatives(records: DataFrame) -> DataFrame:
    """``key, rep, keys``: every record with the smallest record that has the same blocking keys."""
    keyed = records.select("key", blocking_keys().alias("keys"))
    rep = keyed.groupBy("keys").agg(F.min("key").alias("rep"))
    return keyed.join(rep, "keys").select("key", "rep", "keys")


def clusters(nodes: DataFrame, merges: DataFrame, reviews: DataFrame, anchors: DataFrame) -> DataFrame:
    """``node, cluster``: components of merged pairs, then joined by review pairs that touch an anchored cluster.

    ``merges(u, v)``, ``reviews(u, v)``, ``anchors(node)``. Review pairs are added while they
    join clusters of which one is anchored. An anchored cluster so takes in, pair by pair, all
    that review pairs link to it directly or indirectly, which makes the fixpoint a second
    round of components: those that hold an anchor stand, the others fall back to the merged
    pairs. The name of a cluster is its smallest node.
    """
    merges, reviews, anchors = cut(merges.distinct()), cut(reviews.distinct()), cut(anchors.distinct())
    first = smallest_reachable(nodes, merges)
    name = first.select(F.col("node").alias("n"), F.col("cluster").alias("c"))
    ends = reviews.join(name, F.col("u") == F.col("n")).select(F.col("c").alias("cu"), "v").join(name, F.col("v") == F.col("n")).select(F.col("cu").alias("u"), F.col("c").alias("v"))
    second = smallest_reachable(first.select(F.col("cluster").alias("node")).distinct(), ends).select(F.col("node").alias("c1"), F.col("cluster").alias("c2"))
    both = first.join(second, F.col("cluster") == F.col("c1"))
    anchored = both.join(anchors.withColumnRenamed("node", "a"), F.col("node") == F.col("a"), "left_semi").select(F.col("c2").alias("held")).distinct()
    out = both.join(anchored, F.col("c2") == F.col("held"), "left")
    return out.select("node", F.when(F.col("held").isNotNull(), F.col("c2")).otherwise(F.col("cluster")).alias("cluster"))


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, cluster``: the smallest node linked directly or indirectly, by label spreading with shortcuts."""
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    labels = cut(nodes.select("node").union(both.select("u")).distinct().withColumn("cluster", F.col("node")))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("cluster").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        jump = lower.select(F.col("node").alias("j"), F.col("cluster").alias("jc"))
        stepped = cut(lower.join(jump, F.col("cluster") == F.col("j"), "left").select("node", "old", F.coalesce("jc", "cluster").alias("cluster")))
        labels = stepped.select("node", "cluster")
        if stepped.where("old <> cluster").isEmpty():
            return labels
