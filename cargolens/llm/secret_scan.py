"""Secret scans: three base patterns and a randomness test battery, in DataFrame functions alone.

Base matches are leftmost and not overlapping for each kind; one that fails its length test is
dropped. Their places come from the lengths of the pieces between matches, as code points.

The battery looks at all runs of ``CANDIDATE`` characters that mix digits with letters, those inside
base spans included. Their encoding is inferred (hex, base32, base64), each symbol gets its value in
that alphabet, and three tests ask whether the symbols could be random: chi-squared of the alphabet's
counts, runs above and below the alphabet's middle, and lag-1 serial correlation. Bonferroni joins the
three, and a run that they reject at ``RANDOM_LEVEL`` is no key. For the others the null hypothesis is
ordinary text: of n symbols whose coincidence is that of text (``TEXT_COINCIDENCE``) chi-squared is
noncentral, larger the longer the run, and ``p_text`` is the chance of one as small as the run's. Ordinary
runs of hex digits are of two kinds, words and patterns of few symbols, or numbers with a letter here and
there (``NUMBER_LETTERS`` of their symbols), which have few letters but not few symbols; ``p_text`` is the
larger of the chances under both, so a run is reported only where neither explains it.
Benjamini-Hochberg at ``ALPHA`` over these, within bands of length and over all candidates of the band,
says which runs are reported, so the expected share of ordinary text among the reported is bounded, at
each length. Ranks are made of counts of p-values in fixed bins: only the small table of bins is
ordered, never a band's candidates.

A reported run that no base span covers is added as kind ``random``; base spans stay, and those that a
reported run touches are marked as verified.

Null and empty texts have no span; very long texts are scanned whole, and places are added up in pieces,
so a text's time grows little more than with its matches; equal p-values share a bin and are reported
together; repeated rows give the same row again; an empty table gives no rows; extra columns stay in
:func:`scan`, and ``base``, ``tested`` and ``added`` are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base patterns: fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same matches, or a superset of those that pass, found faster.
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ALPHA = 0.05
RANDOM_LEVEL = 0.001
#: Chance that two symbols of ordinary text are equal: of words and patterns of hex digits, of capitals, of words in mixed case.
TEXT_COINCIDENCE = {"hex": 0.14, "base32": 0.066, "base64": 0.055}
#: Share of letters in numbers that are written with hex digits.
NUMBER_LETTERS = 0.1
BANDS = (20, 24, 32, 40, 48, 64, 96, 128, 256)
BINS_PER_DECADE = 50
#: Candidate runs that one task tests.
TASK_RUNS = 2000


#: Matches whose places are added up in one piece.
_PIECE = 256


def _let(value: F.Column, body) -> F.Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _places(text: F.Column, pattern: str, group: int = 0) -> F.Column:
    """array<struct<start, end, hit>> of all matches of a pattern; ``hit`` is the group's text."""
    matches = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    size = lambda part, found: F.struct(F.length(part).alias("gap"), F.length(found).alias("n"), found.alias("hit"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["n"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["hit"].alias("hit")))).alias("out"),
    )
    length = lambda piece: F.aggregate(piece, F.lit(0), lambda n, x: n + x["gap"] + x["n"])

    def sizes(found: F.Column) -> F.Column:
        both = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, size)
        return both if not group else F.zip_with(both, matches(group), lambda x, h: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), h.alias("hit")))

    def pieces(all_: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _PIECE).cast("int")), lambda i: F.slice(all_, i * _PIECE + 1, _PIECE))

    def placed(parts: F.Column) -> F.Column:
        offsets = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, offsets, lambda piece, at: F.aggregate(piece, F.struct(at.alias("at"), none.alias("out")), step)["out"]))

    return _let(matches(0), lambda found: F.when(F.size(found) > 0, _let(sizes(found), lambda all_: _let(pieces(all_), placed))).otherwise(none))


def _when_found(maybe: F.Column, text: F.Column, pattern: str, value: F.Column) -> F.Column:
    """``value`` where the pattern is found; ``maybe`` is a cheap test that no text with a match fails."""
    return F.when(maybe & text.rlike(pattern), value).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: array<struct<kind, start, end>> in order of start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.lower(text)
    named = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    found = {
        "assign": _when_found(named, text, ASSIGN, F.filter(_places(text, ASSIGN, 2), lambda x: F.length(x["hit"]) >= 8)),
        "access": _when_found(text.contains("AKIA"), text, ACCESS, F.filter(_places(text, ACCESS), lambda x: F.length(x["hit"]) >= 16)),
        "hex": _when_found(F.lit(True), text, HEX_LONG, _places(text, HEX_LONG)),
    }

    def tag(rank: int, kind: str, spans: F.Column) -> F.Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    tagged = [tag(i, k, c) for i, (k, c) in enumerate(found.items())]
    return docs.withColumn("base", F.array_sort(F.concat(*tagged)))


def _normal_tail(z: F.Column) -> F.Column:
    """Upper tail of the standard normal, to about 1e-7 (Abramowitz and Stegun 26.2.17); negative z gives over a half."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(runs: DataFrame) -> DataFrame:
    """runs: rows with ``hit``. Adds encoding, n, z_chi, z_runs, z_serial, p (of randomness), p_text (of ordinary text) and band."""
    hit = F.col("hit")
    kind = F.when(hit.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(hit.rlike(r"^[A-Z2-7]+$"), "base32").otherwise("base64")
    out = runs.withColumn("encoding", kind)
    alphabet = F.when(F.col("encoding") == "hex", F.lit("0123456789abcdef")).when(F.col("encoding") == "base32", F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    plain = F.when(F.col("encoding") == "hex", F.lower(hit)).otherwise(F.translate(hit, "-_", "+/"))
    out = out.withColumn("_a", alphabet).withColumn("_t", plain).withColumn("k", F.length("_a").cast("double"))
    out = out.withColumn("v", F.expr("transform(filter(split(_t, ''), c -> c <> ''), c -> double(instr(_a, c) - 1))")).withColumn("n", F.size("v").cast("double"))
    squares = F.expr("aggregate(transform(sequence(0, int(k) - 1), s -> double(size(filter(v, x -> x = s)))), 0D, (a, c) -> a + c * c)")
    out = out.withColumn("chi2", squares * F.col("k") / F.col("n") - F.col("n"))
    df = F.col("k") - 1
    out = out.withColumn("z_chi", (F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    out = out.withColumn("_up", F.expr("transform(v, x -> if(x >= k / 2, 1, 0))")).withColumn("_n1", F.expr("double(aggregate(_up, 0, (a, x) -> a + x))"))
    out = out.withColumn("_r", F.expr("1D + aggregate(sequence(1, size(_up) - 1), 0, (a, i) -> a + if(_up[i] <> _up[i - 1], 1, 0))"))
    p, n = F.col("_n1") * (F.col("n") - F.col("_n1")) / F.col("n"), F.col("n")
    mean, var = 2 * p + 1, F.greatest(2 * p * (2 * p - 1) / (n - 1), F.lit(1e-9))
    # one side only of the symbols: as unlike a coin as can be
    out = out.withColumn("z_runs", F.when(p == 0, F.sqrt(n)).otherwise((F.col("_r") - mean) / F.sqrt(var)))
    out = out.withColumn("_m", F.expr("aggregate(v, 0D, (a, x) -> a + x)") / n)
    spread = F.expr("aggregate(v, 0D, (a, x) -> a + (x - _m) * (x - _m))")
    lagged = F.expr("aggregate(sequence(1, size(v) - 1), 0D, (a, i) -> a + (v[i] - _m) * (v[i - 1] - _m))")
    out = out.withColumn("_s", spread).withColumn("z_serial", F.when(F.col("_s") == 0, F.sqrt(n)).otherwise((lagged / F.col("_s") + 1 / n) * F.sqrt(n)))
    excess = F.col("n") * (F.col("k") * F.create_map(*[F.lit(x) for kv in TEXT_COINCIDENCE.items() for x in kv])[F.col("encoding")] - 1)
    of_text = _normal_tail((df + excess - F.col("chi2")) / F.sqrt(2 * (df + 2 * excess)))
    letters = F.expr("double(size(filter(v, x -> x >= 10)))")
    of_number = _normal_tail((letters - 0.5 - n * NUMBER_LETTERS) / F.sqrt(n * NUMBER_LETTERS * (1 - NUMBER_LETTERS)))
    out = out.withColumn("p_text", F.greatest(of_text, F.when(F.col("encoding") == "hex", of_number).otherwise(of_text), F.lit(1e-40)))
    least = F.least(_normal_tail(F.col("z_chi")), 2 * _normal_tail(F.abs("z_runs")), 2 * _normal_tail(F.abs("z_serial")))
    band = F.lit(0)
    for b in BANDS[1:]:
        band = band + (F.col("n") >= b).cast("int")
    return out.withColumn("p", F.greatest(F.least(3 * least, F.lit(1.0)), F.lit(1e-40))).withColumn("band", band).drop("_a", "_t", "v", "k", "_up", "_n1", "_r", "_m", "_s", "chi2")


def random_runs(tested: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The tested runs that randomness isn't rejected for, and ordinary text is under false-discovery control in their band."""
    placed = tested.withColumn("bin", F.floor(-F.log10("p_text") * BINS_PER_DECADE).cast("int"))
    counts = placed.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("c"))
    # A bin's hypotheses are rejected where its largest p is at most alpha * (as many as lie in it and below) / all. The table has at most bands x 2000 rows.
    totals = counts.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("bin", "c")), asc=False).alias("bins"), F.sum("c").alias("m"))
    ranked = totals.withColumn("sums", F.expr("aggregate(bins, cast(array() as array<struct<bin:int,upto:bigint>>), (acc, x) -> concat(acc, array(struct(x.bin as bin, if(size(acc) = 0, 0L, acc[size(acc) - 1].upto) + x.c as upto))))"))
    passed = F.expr(f"array_min(transform(filter(sums, s -> pow(10D, -s.bin / {float(BINS_PER_DECADE)}D) <= {alpha} * s.upto / m), s -> s.bin))")
    limits = ranked.select("band", F.coalesce(passed, F.lit(2**30)).alias("limit_bin"))
    return placed.join(F.broadcast(limits), "band").where((F.col("bin") >= F.col("limit_bin")) & (F.col("p") >= RANDOM_LEVEL)).drop("bin", "limit_bin")


def _uncovered(runs: F.Column, base: F.Column) -> F.Column:
    """Of runs those that no single base span covers, by one pass over both in order of start."""
    mark = lambda spans, tag: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(tag).alias("tag"), x["end"].alias("end")))
    both = F.array_sort(F.concat(mark(base, 0), mark(runs, 1)))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end"), F.lit("random").alias("kind"))
    step = lambda acc, x: F.struct(
        F.when(x["tag"] == 0, F.greatest(acc["reach"], x["end"])).otherwise(acc["reach"]).alias("reach"),
        F.when((x["tag"] == 1) & (x["end"] > acc["reach"]), F.concat(acc["out"], F.array(span(x)))).otherwise(acc["out"]).alias("out"),
    )
    return F.aggregate(both, F.struct(F.lit(0).alias("reach"), none.alias("out")), step)["out"]


def scan(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc rows with ``base``, ``tested`` (runs that the battery reports, with their test values) and ``added`` (those that no base span covers); the text isn't kept."""
    from .common import written

    text = F.coalesce(F.col("text"), F.lit(""))
    mixed = lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")
    found = _when_found(text.rlike("[0-9]"), text, CANDIDATE, F.filter(_places(text, CANDIDATE), mixed))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "base", "tested", "added")]
    rows = docs.select(F.struct(*own).alias("_own"), "text", F.monotonically_increasing_id().alias("_row"), found.alias("_runs"))
    keyed = written(base_spans(rows).drop("text"), "secret-rows")
    runs = keyed.where("size(_runs) > 0").select("_row", F.explode("_runs").alias("x")).select("_row", "x.*")
    # candidates are few and their tests long, so they are dealt out by their number, not by the table's bytes
    tasks = -(-runs.count() // TASK_RUNS)
    dealt = runs.repartition(tasks, "_row", "start") if tasks > 1 else runs
    # the ranking and what it selects both read the tests' results, which are written once
    random = random_runs(written(battery(dealt).select("_row", "start", "end", "encoding", "p", "p_text", "band"), "tested-runs"), alpha)
    tested = random.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "encoding", "p", "p_text"))).alias("tested"))
    out = keyed.join(tested, "_row", "left").withColumn("tested", F.coalesce("tested", F.array().cast("array<struct<start:int,end:int,encoding:string,p:double,p_text:double>>")))
    return out.select("_own.*", "base", "tested", _uncovered(F.col("tested"), F.col("base")).alias("added"))


def verified(base: F.Column, tested: F.Column) -> F.Column:
    """The base spans that a reported run touches."""
    return F.filter(base, lambda b: F.exists(tested, lambda t: (t["start"] < b["end"]) & (t["end"] > b["start"])))


def _said(spans: F.Column) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _digest() -> list[F.Column]:
    """Counts and hash of the base spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return [*map(count, KINDS), F.sha2(_said(F.col("base")), 256).alias("base_sha256")]


def base_report(docs: DataFrame) -> DataFrame:
    """The contract's columns of the base spans, which SQL can give too."""
    return base_spans(docs.select("doc_id", "text")).select("doc_id", *_digest())


def _sql_matches(rank: int, kind: str, pattern: str, least: int, group: int = 0) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT doc_id, {rank} AS r, '{kind}' AS kind, {least} AS least, string_split_regex(t, {quoted}) AS p, regexp_extract_all(t, {quoted}) AS f, regexp_extract_all(t, {quoted}, {group}) AS g FROM d"


BASE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_sql_matches(0, "assign", ASSIGN, 8, 2)} UNION ALL {_sql_matches(1, "access", ACCESS, 16)} UNION ALL {_sql_matches(2, "hex", "[0-9a-f]{32,}", 32)}),
e AS (SELECT doc_id, r, kind, least, p, f, g, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT doc_id, r, kind, least, length(f[i]) AS n, length(g[i]) AS hit,
  CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e),
k AS (SELECT doc_id, r, kind, a, a + n AS b FROM s WHERE hit >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r), '')) AS base_sha256 FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, the number of added spans, and the base spans that the battery verifies."""
    out = scan(docs.select("doc_id", "text"))
    said = _said
    return out.select("doc_id", *_digest(), said(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"), said(verified(F.col("base"), F.col("tested"))).alias("verified"))
