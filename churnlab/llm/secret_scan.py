"""Secret scan: fixed patterns, and a battery of randomness tests on other runs of encoded text.

The base kinds are patterns (assign, access, hex).  The method adds ``random``
spans.  Candidates are runs of 20 or more characters of ``[A-Za-z0-9+/_-]``, with
the ``=`` that end them, in what base spans leave of the text.  A run with
separators of both base64 and its URL form has no encoding; it is split at those
of one form, whichever leaves the longer piece, or at all where a piece is nearly
as long even so, and every piece of 20 characters is a candidate.  Candidates hold
a digit and a letter and carry at least ``min_bits`` bits in the encoding inferred
from their characters (hex, base32, base36, base62, base64 or its URL form).  Three tests ask whether a candidate
is a random string of that encoding:

* chi-squared uniformity of its alphabet (Wilson-Hilferty normal form);
* the runs test above and below the middle of the alphabet;
* the serial correlation of neighbouring symbols.

Fisher's method joins the three p-values.  Over all candidates of the corpus,
separately by length class (longer runs give the tests more power), the
Benjamini-Hochberg rule rejects randomness with a false-discovery rate of
``alpha``; p-values are first rounded up to a fixed grid, so the rule needs only
counts per grid step.  Candidates that stay random are secrets.

Only built-in functions run, row by row, with one aggregate over grid steps.
Positions are code points, ends exclusive.  A null text is empty.  Repeated rows
repeat their result, but count as often among the candidates; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import let
from .store import stored

# The base patterns.  Runs of fewer than the required characters
# are the whole of a failing match for access and hex, so their lengths can be
# in the pattern; a failing assign match still uses up its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST = 20
# a run; or a shorter one that has the length with the "=" that end it
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]{8,19}=+(?![A-Za-z0-9+/_=-])"
PIECES = tuple(rf"[A-Za-z0-9{x}]{{20,}}=*|[A-Za-z0-9{x}]{{8,19}}=+" for x in ("", "+/", "_-"))
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = (
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
MIN_BITS = 80
ALPHA = 0.05
STRATA = (20, 28, 36, 48, 64, 96)
GRID = 200
LEAST_P = 1e-12


def _spans(text: Column, pattern: str, order: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<s, k, e>> of the leftmost non-overlapping matches; ``group`` must have ``least`` characters."""
    def located(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,ok:boolean>>").alias("out"))
        def step(sizes: Column) -> Column:
            return F.aggregate(sizes, start, lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["len"]).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("s"), F.lit(order).alias("k"),
                                                    (acc["at"] + x["gap"] + x["len"]).alias("e"), x["ok"].alias("ok"))).alias("out")),
                lambda acc: acc["out"])
        inner = F.regexp_extract_all(text, F.lit(pattern), group) if least else found
        sizes = F.zip_with(found, F.zip_with(F.slice(between, 1, F.size(found)), inner,
                                             lambda gap, part: F.struct(F.length(gap).alias("gap"), (F.length(part) >= least).alias("ok"))),
                           lambda m, x: F.struct(x["gap"].alias("gap"), F.length(m).alias("len"), x["ok"].alias("ok")))
        kept = F.filter(step(sizes), lambda x: x["ok"])
        return F.when(F.size(found) > 0, F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))

    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), 0), located), none)


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the logistic approximation (error below 0.0002)."""
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * _upper_tail(F.abs(z)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def randomness(run: Column) -> Column:
    """struct(p, bits) of a run of encoded text; null where no encoding fits."""
    def with_alphabet(bare: Column, letters: Column) -> Column:
        k = F.length(letters).cast("double")
        n = F.length(bare).cast("double")
        symbols = F.filter(F.split(bare, ""), lambda c: c != "")
        same = _total(F.transform(symbols, lambda c: (n - F.length(F.replace(bare, c))).cast("double")))
        x2, df = k / n * same - n, k - 1
        uniform = _upper_tail((F.pow(F.greatest(x2, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

        def of_values(v: Column) -> Column:
            high = F.transform(v, lambda x: (x >= k / 2).cast("double"))
            n1 = _total(high)
            n2 = n - n1
            runs = 1 + _total(F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: (
                (F.get(v, i) >= k / 2) != (F.get(v, i - 1) >= k / 2)).cast("double")))
            mu = 2 * n1 * n2 / n + 1
            var = (mu - 1) * (mu - 2) / (n - 1)
            runs_p = F.when((n1 == 0) | (n2 == 0) | (var <= 0), F.lit(LEAST_P)).otherwise(_two_sided((runs - mu) / F.sqrt(var)))
            mean = _total(v) / n
            spread = _total(F.transform(v, lambda x: (x - mean) * (x - mean)))
            lag = _total(F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: (F.get(v, i) - mean) * (F.get(v, i - 1) - mean)))
            serial = F.when(spread <= 0, F.lit(LEAST_P)).otherwise(_two_sided((lag / spread + 1 / n) * F.sqrt(n)))
            logs = [F.log(F.greatest(p, F.lit(LEAST_P))) for p in (uniform, runs_p, serial)]
            half = -(logs[0] + logs[1] + logs[2])
            return F.exp(-half) * (1 + half + half * half / 2)

        values = F.transform(symbols, lambda c: (F.position(c, letters) - 1).cast("double"))
        return F.struct(let(values, of_values).alias("p"), (n * F.log2(k)).alias("bits"))

    def of(bare: Column) -> Column:
        letters = F.lit(None).cast("string")
        for pattern, alphabet in reversed(ALPHABETS):
            letters = F.when(bare.rlike(pattern), F.lit(alphabet)).otherwise(letters)
        return F.when(F.length(bare) >= 8, let(letters, lambda a: F.when(a.isNotNull(), with_alphabet(bare, a))))

    return let(F.rtrim(run, F.lit("=")), of)


def _without(text: Column, base: Column) -> Column:
    """``text`` with blanks in place of the base spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    blank = F.aggregate(base, start, lambda acc, x: F.when(x["e"] <= acc["at"], acc).otherwise(F.struct(
        x["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))),
                                     F.repeat(F.lit(" "), x["e"] - F.greatest(x["s"], acc["at"]))).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(base) > 0, blank).otherwise(text)


def _pieces(run: Column) -> Column:
    """Spans inside a run that has separators of two encodings."""
    def longest(spans: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(spans, lambda x: x["e"] - x["s"])), F.lit(0))

    def chosen(found: Column) -> Column:
        all_, plain, url = (F.get(found, i) for i in range(3))
        coarse = F.greatest(longest(plain), longest(url))
        return F.when(5 * longest(all_) >= 4 * coarse, all_).when(longest(url) >= coarse, url).otherwise(plain)

    found = F.array(*[F.filter(_spans(run, x, len(KINDS) - 1), lambda x: x["e"] - x["s"] >= LEAST) for x in PIECES])
    return let(found, chosen)


def _candidates(text: Column, base: Column, min_bits: float) -> Column:
    def parts(c: Column) -> Column:
        def of(run: Column) -> Column:
            inner = F.transform(_pieces(run), lambda x: F.struct((c["s"] + x["s"]).alias("s"), x["k"].alias("k"), (c["s"] + x["e"]).alias("e")))
            return F.when(run.rlike("[+/]") & run.rlike("[_-]"), inner).otherwise(F.array(c))
        return let(F.substring(text, c["s"] + 1, c["e"] - c["s"]), of)

    def judged(spans: Column) -> Column:
        runs = F.transform(F.flatten(F.transform(spans, parts)), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"),
                                                    F.substring(text, c["s"] + 1, c["e"] - c["s"]).alias("run")))
        likely = F.filter(runs, lambda c: c["run"].rlike("[0-9]") & c["run"].rlike("[A-Za-z]"))
        tested = F.transform(likely, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), randomness(c["run"]).alias("t")))
        return F.transform(F.filter(tested, lambda c: c["t"]["bits"] >= min_bits), lambda c: F.struct(
            c["s"].alias("s"), c["e"].alias("e"), stratum(c["e"] - c["s"]).alias("stratum"), grid(c["t"]["p"]).alias("step")))
    none = F.array().cast("array<struct<s:int,e:int,stratum:int,step:int>>")
    spans = let(_without(text, base), lambda free: _spans(free, CANDIDATE, len(KINDS) - 1))
    return F.coalesce(let(spans, lambda s: F.when(F.size(s) > 0, judged(s))), none)


def stratum(length: Column) -> Column:
    out = F.lit(0)
    for i, at in enumerate(STRATA):
        out = F.when(length >= at, F.lit(i)).otherwise(out)
    return out


def grid(p: Column) -> Column:
    """The grid step of a p-value, rounded up."""
    return F.ceil(F.log10(F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(1.0))) * GRID).cast("int")


def rejection_steps(found: DataFrame, alpha: float = ALPHA) -> dict[int, int]:
    """By length class, the largest grid step at which Benjamini-Hochberg rejects; ``found`` has a row per candidate."""
    counts = found.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("stratum").orderBy("step")
    every = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "step", F.sum("n").over(up_to).alias("rank"), F.sum("n").over(every).alias("all"))
    hit = ranked.where(F.pow(F.lit(10.0), F.col("step") / GRID) <= alpha * F.col("rank") / F.col("all"))
    return {r["stratum"]: r["step"] for r in hit.groupBy("stratum").agg(F.max("step").alias("step")).collect()}


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = MIN_BITS,
                alpha: float = ALPHA) -> DataFrame:
    """(doc_id, base, added) of every row: arrays of (s, k, e) with k the place of the kind in KINDS."""
    bare = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = stored(_scanned(bare, F.col("text"), "base", "tested", min_bits).drop("text"))
    return kept.select("doc_id", "base", _accepted("tested", _limits(kept.select("tested"), alpha)).alias("added"))


def _scanned(df: DataFrame, text: Column, base: str, tested: str, min_bits: float) -> DataFrame:
    """``df`` with the base spans and the tested candidates of ``text``."""
    spans = F.sort_array(F.concat(_spans(text, ASSIGN, 0, group=2, least=ASSIGN_MIN), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    return df.withColumn(base, spans).withColumn(tested, _candidates(text, F.col(base), min_bits))


def _limits(tested: DataFrame, alpha: float) -> Column:
    """The largest rejected grid step of each length class, from one column of candidates."""
    rows = tested.select(F.explode(tested.columns[0]).alias("c")).select("c.stratum", "c.step")
    steps = rejection_steps(rows, alpha)
    return F.array(*[F.lit(steps.get(i)).cast("int") for i in range(len(STRATA))])


def _accepted(tested: str, limits: Column) -> Column:
    """Spans of the candidates that stay random."""
    return F.transform(F.filter(tested, lambda c: F.coalesce(c["step"] > F.get(limits, c["stratum"]), F.lit(True))),
                       lambda c: F.struct(c["s"].alias("s"), F.lit(len(KINDS) - 1).alias("k"), c["e"].alias("e")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                        _written(F.sort_array(F.concat("base", "added"))).alias("spans"))


_BASE, _TESTED, _SPANS = "__secret_base", "__secret_tested", "__secret_spans"


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", min_bits: float = MIN_BITS,
             alpha: float = ALPHA) -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark``.

    Texts are scanned once for the rejection limits and once where they stand, so spans stay
    with their row: ids play no part, and may be null or repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = _scanned(docs, text, _BASE, _TESTED, min_bits)
    limits = _limits(stored(found.select(_TESTED).where(F.size(_TESTED) > 0)), alpha)
    spanned = found.withColumn(_SPANS, F.sort_array(F.concat(F.col(_BASE), _accepted(_TESTED, limits))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(F.col(_SPANS), start, lambda acc, x: F.when(x["s"] < acc["at"], F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
            x["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return spanned.select(*[F.when(F.col(text_col).isNotNull() & (F.size(_SPANS) > 0), clean).otherwise(F.col(text_col)).alias(c)
                            if c == text_col else F.col(c) for c in docs.columns])
