"""Secret scan: fixed patterns, and a battery of randomness tests for anything that looks encoded.

A candidate is a run of encoding characters with both letters and digits. Its encoding is
inferred from the characters it uses; then three tests ask whether its symbols look drawn at
random from that alphabet: chi-squared uniformity, runs above and below the middle of the
alphabet, and correlation of neighbours. Their combined p-value speaks against randomness.
Candidates are kept as secrets unless a weighted false-discovery control rejects randomness:
long candidates, whose tests have power, get more weight than short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.llm.common import documents, whole, without
from lakesight.session import materialize

# The base patterns. Letters of the keywords match in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ASSIGN_LEAST = 12
# Runs are maximal, so a least length in the pattern finds the same matches as dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: What is left of a run of no encoding, cut more and more.
PARTS = [r"[A-Za-z0-9+_-]{20,}", r"[A-Za-z0-9+]{20,}"]
#: Matches that are walked together.
CHUNK = 64

#: Encodings in the order they are tried: name, characters, alphabet in symbol order.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
KINDS = ["assign", "access", "hex", "random"]
#: Share of random candidates that may be wrongly set aside.
FALSE_DISCOVERY = 0.01
#: p-values are compared in steps of a tenth of a power of e, rounded up; below the last step all are alike.
P_STEPS, P_LAST = 10, 500
OUTPUT = ["spans"]
INNER = ["_key", "_candidates", "_random"]
SPANS = "array<struct<start:int,place:int,end:int,kind:string,value:string>>"


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _once(value: Column, use) -> Column:
    """``use(value)``, where the value is computed once, as a bound variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, place of the kind, end, kind, value), in code points.

    The pieces between the matches and the matches themselves, laid end to end, are the text.
    They are walked in chunks, each from where the one before it ends: lists grow by an item
    at a time only inside a chunk, so the work follows the number of matches.
    """
    place = KINDS.index(kind)

    def span(at: Column, p: Column) -> Column:
        return F.struct((at + p["b"]).alias("start"), F.lit(place).alias("place"), (at + p["b"] + p["n"]).alias("end"),
                        F.lit(kind).alias("kind"), p["value"].alias("value"))

    def walk(chunk: Column, start: Column) -> Column:
        return F.aggregate(
            chunk, F.struct(start.alias("at"), F.array().cast(SPANS).alias("spans")),
            lambda s, p: F.struct((s["at"] + p["b"] + p["n"]).alias("at"), F.concat(s["spans"], F.array(span(s["at"], p))).alias("spans")),
        )["spans"]

    def starts(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, p: s + p["b"] + p["n"]))
        return F.aggregate(
            sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["list"], F.array(s["at"])).alias("list")))["list"]

    def chunked(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, CHUNK))

    def matched(t: Column) -> Column:
        values = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        # The piece behind the last match pairs with nothing.
        pairs = F.filter(F.zip_with(F.split(t, pattern, -1), values, lambda b, v: F.struct(
            F.char_length(b).alias("b"), F.char_length(v).alias("n"), v.alias("value"))), lambda p: p["value"].isNotNull())
        return _once(pairs, lambda p: _once(chunked(p), lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), walk))))

    return F.when(text.rlike(pattern), _once(text, matched)).otherwise(F.array().cast(SPANS))


def _encoding(value: Column) -> Column:
    """The first encoding whose characters the value has, with its alphabet; null if none."""
    return F.coalesce(*[
        F.when(value.rlike(r), F.struct(F.lit(name).alias("encoding"), F.lit(a).alias("alphabet"))) for name, r, a in ENCODINGS])


def candidate_spans(text: Column) -> Column:
    """The runs that are tested. A run of no encoding, such as a path around a token, is cut at slashes, then at hyphens and underscores."""
    def cut(spans: Column, patterns: list[str]) -> Column:
        def parts(s: Column) -> Column:
            inner = F.transform(found(s["value"], patterns[0], "random"), lambda i: F.struct(
                (s["start"] + i["start"]).alias("start"), i["place"].alias("place"), (s["start"] + i["end"]).alias("end"), i["kind"].alias("kind"), i["value"].alias("value")))
            return F.when(_encoding(s["value"]).isNotNull(), F.array(s)).otherwise(cut(inner, patterns[1:]) if patterns[1:] else inner)

        return F.flatten(F.transform(spans, parts))

    runs = found(text, CANDIDATE, "random")
    whole_run = F.filter(runs, lambda s: _mixed(s["value"]))
    return F.when(F.exists(whole_run, lambda s: _encoding(s["value"]).isNull()), F.filter(cut(whole_run, PARTS), lambda s: _mixed(s["value"]))).otherwise(whole_run)


def _upper_normal(z: Column) -> Column:
    """P(Z > z) of the normal distribution, to about 1e-7 (rational approximation of erfc)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(tokens: DataFrame) -> DataFrame:
    """Add ``n``, ``p_chi``, ``p_runs``, ``p_serial`` and their combination ``p`` to (value, alphabet)."""
    letters = F.filter(F.split("value", ""), lambda c: c != "")
    symbols = F.transform(letters, lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    t = tokens.withColumns({"_s": F.filter(symbols, lambda v: v >= 0), "_a": F.length("alphabet").cast("double")})
    t = t.withColumns({"n": F.size("_s"), "_sorted": F.array_sort("_s")})
    # Σ count² as Σ over the sorted symbols of 2·(place within equals) − 1.
    squares = F.aggregate(
        F.col("_sorted"),
        F.struct(F.lit(-1.0).alias("v"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum")),
        lambda s, v: F.struct(
            v.alias("v"), F.when(s["v"] == v, s["k"] + 1).otherwise(1.0).alias("k"),
            (s["sum"] + 2 * F.when(s["v"] == v, s["k"] + 1).otherwise(1.0) - 1).alias("sum"),
        ),
    )["sum"]
    middle, mean = F.col("_a") / 2, F.aggregate("_s", F.lit(0.0), lambda s, v: s + v) / F.col("n")
    t = t.withColumns({"_mean": mean, "_squares": squares}).withColumns({
        "_high": F.aggregate("_s", F.lit(0.0), lambda s, v: s + (v >= middle).cast("double")),
        "_next": F.slice("_s", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))),
        "_var": F.aggregate("_s", F.lit(0.0), lambda s, v: s + (v - F.col("_mean")) * (v - F.col("_mean"))),
    })
    pairs = F.arrays_zip(F.slice("_s", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0))).alias("a"), F.col("_next").alias("b"))
    t = t.withColumns({
        "_turns": F.aggregate(pairs, F.lit(0.0), lambda s, p: s + ((p["a"] >= middle) != (p["b"] >= middle)).cast("double")),
        "_cov": F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - F.col("_mean")) * (p["b"] - F.col("_mean"))),
    })
    n, low = F.col("n").cast("double"), F.col("n") - F.col("_high")
    df = F.col("_a") - 1
    chi = F.greatest(F.col("_a") * F.col("_squares") / n - n, F.lit(0.0))
    spread = 2 / (9 * df)
    chi_z = (F.pow(chi / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    both = 2 * F.col("_high") * low
    runs_var = both * (both - n) / (n * n * (n - 1))
    runs_z = F.when(runs_var > 0, (F.col("_turns") + 1 - both / n - 1) / F.sqrt(runs_var))
    serial_z = F.when(F.col("_var") > 0, (F.col("_cov") / F.col("_var") + 1 / n) * F.sqrt(n))

    def two_sided(z: Column) -> Column:
        # No variation at all is no randomness.
        return F.coalesce(F.least(2 * _upper_normal(F.abs(z)), F.lit(1.0)), F.lit(1e-300))

    t = t.withColumns({"p_chi": _upper_normal(chi_z), "p_runs": two_sided(runs_z), "p_serial": two_sided(serial_z)})
    # Fisher's combination of three: chi-squared with six degrees, in closed form.
    half = -(sum((F.log(F.greatest(F.col(c), F.lit(1e-300))) for c in ("p_chi", "p_runs", "p_serial")), F.lit(0.0)))
    p = F.exp(-half) * (1 + half + half * half / 2)
    return t.withColumn("p", F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0))).drop(
        "_s", "_a", "_sorted", "_mean", "_squares", "_high", "_next", "_var", "_turns", "_cov"
    )


def _weight() -> Column:
    """Weight of a test by the candidate's length, before the mean is brought to 1."""
    return F.least(F.log2(F.col("n").cast("double")), F.lit(8.0))


def rejection_step(tested: DataFrame) -> int:
    """The weighted step-up rule over all candidates: -1, or the last step of p/weight that is rejected.

    Only counts per step are gathered, at most ``P_LAST`` + 1 rows whatever the input.
    """
    total, weights = tested.agg(F.count(F.lit(1)), F.sum(_weight())).first()
    if not total:
        return -1
    steps = tested.select(_step(total / weights).alias("step")).groupBy("step").count().collect()
    below, best = 0, -1
    for step, count in sorted(((r["step"], r["count"]) for r in steps), reverse=True):
        below += count
        # All p/weight of this step are at most exp(-step / P_STEPS).
        if 2.718281828459045 ** (-step / P_STEPS) <= FALSE_DISCOVERY * below / total:
            best = step
    return best


def _step(unit: float) -> Column:
    """Larger steps are smaller p-values."""
    weighted = F.col("p") / (_weight() * unit)
    return F.least(F.floor(-F.log(F.greatest(weighted, F.lit(1e-300))) * P_STEPS), F.lit(P_LAST)).cast("int")


def candidates(docs: DataFrame) -> DataFrame:
    """Distinct candidates with their encoding; each is tested once, wherever it occurs."""
    text = whole("text")
    spans = docs.filter(text.rlike(CANDIDATE)).select(F.explode(candidate_spans(text)["value"]).alias("value"))
    return spans.distinct().withColumn("_e", _encoding(F.col("value"))).filter("_e is not null").select(
        "value", "_e.encoding", "_e.alphabet"
    )


def random_tokens(docs: DataFrame) -> DataFrame:
    """(value, encoding, n, p): the candidates that pass as random."""
    tested = materialize(_battery(candidates(docs)).select("value", "encoding", "n", "p"), "tokens")
    last = rejection_step(tested)
    if last < 0:
        return tested
    total, weights = tested.agg(F.count(F.lit(1)), F.sum(_weight())).first()
    return tested.filter(_step(total / weights) < last)


def secret_spans(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with ``spans``: (start, place, end, kind, value), by start, then kind as in ``KINDS``.

    Positions count code points, ends are exclusive. A null text counts as empty and has an
    empty array, as has any text without a find; an empty table gives an empty table. Input
    columns named like the output or as in ``INNER`` are left out. Repeated rows are each scanned. Candidates of
    the tests that are also base matches appear under both kinds.
    """
    text = whole("text")
    docs = without(docs, *OUTPUT, *INNER)
    assign = F.filter(
        found(text, ASSIGN, "assign"),
        lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= ASSIGN_LEAST,
    )
    base = F.concat(assign, found(text, ACCESS, "access"), found(text, HEX, "hex"))
    scanned = docs.withColumns({
        "_key": F.monotonically_increasing_id(),
        "_candidates": candidate_spans(text),
    })
    tokens = random_tokens(docs)
    some = scanned.filter(F.size("_candidates") > 0)
    # Rows without a candidate pass straight through; of the others the tokens travel, then what they found.
    hits = (
        some.select("_key", F.explode("_candidates").alias("_c"))
        .join(tokens, F.col("_c.value") == F.col("value"), "left_semi")
        .groupBy("_key").agg(F.collect_list("_c").alias("_random"))
    )
    rest = scanned.filter(F.size("_candidates") == 0).withColumn("_random", F.lit(None))
    every = rest.unionByName(some.join(hits, "_key", "left").select(*scanned.columns, "_random"))
    return every.withColumn("spans", F.array_sort(F.concat(base, F.coalesce("_random", F.array().cast(SPANS))))).drop(*INNER)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secrets(spark, folder: str) -> DataFrame:
    """Secrets of all documents."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    kinds = {k: count(k) for k in KINDS}
    return secret_spans(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id",
        kinds["assign"].alias("n_assign"), kinds["access"].alias("n_access"), kinds["hex"].alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        kinds["random"].alias("n_random"),
    )
