"""Name confusion: repository identifiers against a corpus of well-known names.

The corpus is small by nature (thousands of names), and its size is checked before it is broadcast;
beyond the bound, exact look-ups become shuffle joins, nearest names meet by what deletions leave of short
names or by segments of long ones, and embedded names by their rarest gram."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import knowledge as K
from ..functions.names import canonical, confusable_candidates, non_ascii, osa_distance
from ..model import FINDING_COLUMNS, emit, rule

#: Names up to which the corpus is broadcast.
BROADCAST_NAMES = 200_000


def seed_corpus(spark: SparkSession) -> DataFrame:
    """(kind, name): the built-in organisations and models."""
    return spark.createDataFrame([("org", n) for n in K.SEED_ORGS] + [("model", n) for n in K.SEED_MODELS], "kind string, name string")


def refreshed_corpus(listing: DataFrame, limit: int = 1000) -> DataFrame:
    """(kind, name) of the most downloaded repositories. listing: id, downloads."""
    top = listing.where("id is not null").orderBy(F.desc("downloads"), "id").limit(limit)
    parts = F.split("id", "/", 2)
    orgs = top.where(F.col("id").contains("/")).select(F.lit("org").alias("kind"), parts[0].alias("name"))
    models = top.select(F.lit("model").alias("kind"), F.lower(F.element_at(parts, -1)).alias("name"))
    return orgs.unionByName(models).where("name <> ''").distinct()


def keyed_corpus(corpus: DataFrame) -> DataFrame:
    """A row for each canonical form of a kind, with its smallest name."""
    return corpus.withColumn("key", canonical(F.col("name"))).groupBy("kind", "key").agg(F.min("name").alias("name"))


def split_ids(ids: DataFrame) -> DataFrame:
    """ids: repo_id. Adds org (empty without a slash), model, and their canonical forms."""
    has = F.col("repo_id").contains("/")
    out = ids.withColumn("org", F.when(has, F.substring_index("repo_id", "/", 1)).otherwise("")).withColumn("model", F.when(has, F.expr("substring(repo_id, instr(repo_id, '/') + 1)")).otherwise(F.col("repo_id")))
    return out.withColumn("org_key", canonical(F.col("org"))).withColumn("model_key", canonical(F.col("model")))


def nearest(names: DataFrame, keys: DataFrame, cap: int) -> DataFrame:
    """names: (key) distinct; keys: (known_key, name). (key, name, distance) of the nearest known name
    within ``cap`` edits, the smallest name on a tie. The known side must be small: it is broadcast."""
    band = F.abs(F.length("key") - F.length("known_key")) <= cap
    pairs = names.join(F.broadcast(keys), band).withColumn("distance", F.when(F.col("key") == F.col("known_key"), 0).otherwise(osa_distance(F.col("key"), F.col("known_key"))))
    return pairs.where(F.col("distance") <= cap).groupBy("key").agg(F.min(F.struct("distance", "name")).alias("x")).select("key", "x.*")


def _deletions(key: F.Column) -> F.Column:
    """The string and all that remain after deleting one character."""
    return F.array_distinct(F.concat(F.array(key), F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.concat(F.substring(key, 1, i - 1), F.substring(key, i + 1, F.length(key))))))


#: Known names up to this length meet by what deletions leave, longer ones by segments, whose number doesn't grow with the length.
DELETED_LENGTH = 20


def _deletion_pairs(names: DataFrame, keys: DataFrame, cap: int) -> DataFrame:
    """Pairs that share a string after at most ``cap`` deletions each, as names within ``cap`` edits or swaps do."""
    a, b = names.withColumn("_d", F.array("key")), keys.withColumn("_d", F.array("known_key"))
    for _ in range(cap):
        step = F.array_distinct(F.flatten(F.transform("_d", _deletions)))
        a, b = a.withColumn("_d", step), b.withColumn("_d", step)
    return a.withColumn("_d", F.explode("_d")).join(b.withColumn("_d", F.explode("_d")), "_d").select("key", "known_key", "name")


def _segment_pairs(names: DataFrame, keys: DataFrame, cap: int, least: int) -> DataFrame:
    """Pairs of a known name of ``least`` characters or more that share one of its segments, at most ``cap`` places off.

    An edit touches one segment and a swap at most two, so of ``2 * cap + 1`` segments one is whole in any name
    within ``cap`` edits or swaps. A segment's number and the known name's length are part of the key."""
    n = 2 * cap + 1
    start, size = f"int(m * i div {n})", f"int(m * (i + 1) div {n} - m * i div {n})"
    parts = keys.withColumn("m", F.length("known_key")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("part", F.expr(f"substring(known_key, {start} + 1, {size})"))
    probes = names.withColumn("l", F.length("key")).where(F.col("l") >= least - cap)
    probes = probes.withColumn("m", F.explode(F.expr(f"sequence(greatest({least}, l - {cap}), greatest({least}, l + {cap}))"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    probes = probes.withColumn("at", F.explode(F.expr(f"transform(sequence(-{cap}, {cap}), s -> {start} + s)"))).where(f"at >= 0 and at + {size} <= l")
    probes = probes.withColumn("part", F.expr(f"substring(key, at + 1, {size})")).select("key", "m", "i", "part").distinct()
    return probes.join(parts, ["m", "i", "part"]).select("key", "known_key", "name")


def candidate_pairs(names: DataFrame, keys: DataFrame, cap: int, deleted_length: int = DELETED_LENGTH) -> DataFrame:
    """(key, known_key, name) that hold all pairs within ``cap`` edits or swaps."""
    short = _deletion_pairs(names.where(F.length("key") <= deleted_length + cap), keys.where(F.length("known_key") <= deleted_length), cap)
    long = _segment_pairs(names, keys.where(F.length("known_key") > deleted_length), cap, deleted_length + 1)
    return short.unionByName(long).where(F.abs(F.length("key") - F.length("known_key")) <= cap).distinct()


def nearest_joined(names: DataFrame, keys: DataFrame, cap: int) -> DataFrame:
    """The same for a corpus of any size, from candidates that meet in joins."""
    pairs = candidate_pairs(names, keys, cap)
    pairs = pairs.withColumn("distance", F.when(F.col("key") == F.col("known_key"), 0).otherwise(osa_distance(F.col("key"), F.col("known_key"))))
    return pairs.where(F.col("distance") <= cap).groupBy("key").agg(F.min(F.struct("distance", "name")).alias("x")).select("key", "x.*")


#: Characters of a known name from which on another name may embed it.
EMBEDDED = 5


def embedded(names: DataFrame, keys: DataFrame) -> DataFrame:
    """names: (key); keys: (known_key, name). (key, name) of all known names of ``EMBEDDED`` characters or more that a name
    contains, for a corpus of any size: a known name is indexed under that one of its grams which the fewest names have,
    and a name looks up each of its grams, as many as it has characters."""
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (EMBEDDED - 1)), lambda i: F.substring(c, i, F.lit(EMBEDDED))))).alias("gram")
    of_names = names.where(F.length("key") >= EMBEDDED).select("key", grams(F.col("key")))
    counts = of_names.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    of_keys = keys.where(F.length("known_key") >= EMBEDDED).select("known_key", "name", grams(F.col("known_key")))
    # a known name with a gram that no name has is in none of them
    rarest = of_keys.join(counts, "gram", "left").groupBy("known_key", "name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0")
    pairs = of_names.join(rarest.select("known_key", "name", F.col("x.gram").alias("gram")), "gram")
    return pairs.where(F.col("key").contains(F.col("known_key"))).select("key", "name")


def findings(ids: DataFrame, corpus: DataFrame, corpus_age_days: int | None = None, broadcast_names: int = BROADCAST_NAMES, kept: list[DataFrame] | None = None) -> DataFrame:
    """SQT-001 to 009. ids: target_id, repo_id; corpus: kind, name. Each identifier is judged once, however many targets have it.

    The folded names are persisted; ``kept`` gets these tables, for the caller to unpersist."""
    once = ids.select("repo_id").where("repo_id is not null").distinct().withColumn("target_id", F.col("repo_id"))
    found = _judged(once, corpus, corpus_age_days, broadcast_names, kept).withColumnRenamed("target_id", "repo_id")
    return found.join(ids.select("target_id", "repo_id"), "repo_id").select(*FINDING_COLUMNS)


def _judged(ids: DataFrame, corpus: DataFrame, corpus_age_days: int | None, broadcast_names: int, kept: list[DataFrame] | None) -> DataFrame:
    # names are folded in Python, so that is done once and kept: the branches below would each do it again, with workers of their own
    known = keyed_corpus(corpus).persist(StorageLevel.MEMORY_AND_DISK)
    small = known.limit(broadcast_names + 1).count() <= broadcast_names
    hint = F.broadcast if small else lambda df: df
    near = nearest if small else nearest_joined
    of = lambda kind: known.where(F.col("kind") == kind)
    org_names, orgs, models = corpus.where("kind = 'org'").select(F.col("name").alias("org")).distinct(), of("org"), of("model")
    at = split_ids(ids).withColumn("location", F.col("repo_id")).persist(StorageLevel.MEMORY_AND_DISK)
    if kept is not None:
        kept += [known, at]
    at = at.join(hint(orgs.select(F.col("key").alias("org_key"), F.col("name").alias("known_org"))), "org_key", "left")
    at = at.join(hint(org_names.withColumn("exact", F.lit(True))), "org", "left")
    at = at.join(hint(models.select(F.col("key").alias("model_key"), F.col("name").alias("known_model"))), "model_key", "left")
    strange = at.where("org <> '' and known_org is null")

    names = strange.select(F.col("org_key").alias("key")).distinct()
    folds = names.select("key", F.explode(confusable_candidates(F.col("key"))).alias("candidate")).where("candidate <> key")
    folded = folds.join(hint(orgs.select(F.col("key").alias("candidate"), "name")), "candidate").groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("folds"))
    left = names.join(folded, "key", "left_anti")
    close = near(left, orgs.select(F.col("key").alias("known_key"), "name"), 2).where("distance > 0")
    rest = left.join(close, "key", "left_anti")
    keys = orgs.select(F.col("key").alias("known_key"), "name")
    if small:
        embeds = rest.join(F.broadcast(keys), (F.length("known_key") >= EMBEDDED) & F.col("key").contains(F.col("known_key")))
    else:
        embeds = embedded(rest, keys)
    embeds = embeds.groupBy("key").agg(F.min("name").alias("name"))
    near_models = near(at.where("known_model is null").select(F.col("model_key").alias("key")).distinct(), models.select(F.col("key").alias("known_key"), "name"), 1).where("distance = 1")

    # what was learnt of a form goes back to all identifiers that have it
    facts = folded.select("key", "folds", F.lit(None).cast("int").alias("distance"), F.lit(None).cast("string").alias("near"), F.lit(None).cast("string").alias("embeds"))
    facts = facts.unionByName(close.select("key", F.lit(None).cast("array<string>").alias("folds"), F.col("distance").cast("int").alias("distance"), F.col("name").alias("near"), F.lit(None).cast("string").alias("embeds")))
    facts = facts.unionByName(embeds.select("key", F.lit(None).cast("array<string>").alias("folds"), F.lit(None).cast("int").alias("distance"), F.lit(None).cast("string").alias("near"), F.col("name").alias("embeds")))
    all_ = at.join(facts.withColumnRenamed("key", "org_key"), "org_key", "left").join(near_models.select(F.col("key").alias("model_key"), F.col("name").alias("typed")), "model_key", "left")
    strange_org = "org <> '' and known_org is null"
    same_letters = F.lower("org") == F.lower("known_org")
    seen = lambda mine, known: F.array(F.concat_ws(" ", mine, F.lit("for"), known))
    signs = F.slice(F.regexp_extract_all("repo_id", F.lit(r"[^\x00-\x7F]"), F.lit(0)), 1, 6)
    rules = [
        rule("SQT-001", non_ascii(F.col("repo_id")), "HIGH", "naming", evidence=F.transform(signs, lambda c: F.concat(c, F.lit(" "), F.hex(F.encode(c, "UTF-16BE"))))),
        rule("SQT-002", f"{strange_org} and near is not null", F.when(F.col("distance") == 1, "HIGH").otherwise("MEDIUM"), "naming", detail=F.concat_ws(" ", F.col("distance").cast("string"), F.lit("edits from"), "near"), evidence=seen("org", "near")),
        rule("SQT-003", f"{strange_org} and folds is not null", "HIGH", "naming", evidence=F.slice("folds", 1, 3)),
        rule("SQT-004", f"{strange_org} and embeds is not null", "MEDIUM", "naming", "medium", evidence=seen("org", "embeds")),
        rule("SQT-005", f"{strange_org} and known_model is not null", "HIGH", "naming", detail=F.col("model")),
        rule("SQT-006", "known_model is null and typed is not null", F.when(F.col("known_org").isNotNull(), "MEDIUM").otherwise("HIGH"), "naming", "medium", evidence=seen("model", "typed")),
        rule("SQT-007", "org like '-%' or org like '%-' or org like '%--%'", "LOW", "naming", "low", evidence=F.array("org")),
        rule("SQT-008", "org <> '' and known_org is not null and exact is null", F.when(same_letters, "LOW").otherwise("HIGH"), "naming", F.when(same_letters, "low").otherwise("high"), evidence=seen("org", "known_org")),
    ]
    if corpus_age_days is not None and corpus_age_days > K.STALE_DAYS:
        rules.append(rule("SQT-009", F.lit(True), "INFO", "naming", detail=f"corpus is {corpus_age_days} days old"))
    return emit(all_, *rules)
