"""Secret scan: fixed patterns, and a randomness battery with length-aware false-discovery control.

DataFrame functions only. Three fixed patterns give the base spans. The method adds spans of kind ``random``:

* candidates are runs of 16 or more base64 characters that touch no base span;
* the encoding of each is inferred (hex, base32, base64), and its symbols are tested against that alphabet: chi-squared
  tests of uniformity over all symbols and over pooled cells (upper case, lower case, the rest; cells are pooled as
  expected counts of short strings would be too low), a runs test about the alphabet's middle, and a lag-one serial
  correlation test; the least of the p-values is combined by Sidak's rule. A random string has a uniform p-value, a
  word a tiny one;
* per encoding and length band (powers of two: short strings carry less evidence), the share of random strings is
  estimated from the p-values above ``LAMBDA`` (Storey's estimate), and the least cut is taken at which the estimated
  share of non-random strings among those accepted is at most ``FALSE_SHARE``. All cuts lie well below ``LAMBDA``, so
  that a band in which p-values thin out towards 1 has none, and nothing is accepted there. Counts cover all documents; the table
  of cuts has at most one row per encoding and power of two.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated results; null ``doc_id``
values pass through; an empty table gives an empty table; only ``doc_id`` and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.llm.shared import checkpointed, text_or_empty

#: Fixed patterns of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the method.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
LAMBDA, FALSE_SHARE = 0.5, 0.05
CUTS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)

#: Matches whose places are added up at once.
RUN = 256
_SPANS = "array<struct<start:bigint,end:bigint,value:string,part:string>>"


def _located(text: str, pattern: str, matches: str, parts: Column | None = None) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, which column ``matches`` holds, in code points.

    The text between matches gives the places. They are added up within runs of ``RUN`` matches and then from run to
    run, so that a text with many matches does not copy a growing array at every one.
    """
    between = F.split(F.col(text), pattern, -1)
    both = F.arrays_zip(between.alias("before"), F.col(matches).alias("value"), *([parts.alias("part")] if parts is not None else []))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.coalesce(F.length(x["value"]), F.lit(0))
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), x["value"].alias("value"), (x["part"] if parts is not None else x["value"]).alias("part"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def moved(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), (span["end"] + by).alias("end"), span["value"].alias("value"), span["part"].alias("part"))

    def in_runs(known: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(known) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(known, i * RUN + 1, F.lit(RUN)), start, step))
        return _once(runs, joined)

    def joined(runs: Column) -> Column:
        starts = F.aggregate(runs, F.array(F.lit(0).cast("long")), lambda acc, r: F.array_append(acc, F.element_at(acc, -1) + r["at"]))
        return _once(starts, lambda at: F.flatten(F.transform(runs, lambda r, i: F.transform(r["out"], lambda s: moved(s, F.get(at, i))))))

    found = F.when(F.size(matches) < RUN, F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(_once(both, in_runs))
    return F.when(F.size(matches) > 0, F.filter(found, lambda s: s["value"].isNotNull())).otherwise(F.array().cast(_SPANS))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda would compute what it captures at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``assign``, ``access``, ``hex``: arrays of spans with their text."""
    rows = docs.withColumn("__t", text_or_empty(text))
    long_hex, long_access = HEX[:-1] + f"{{{LEAST_HEX},}}", ACCESS[:-1] + f"{{{LEAST_ACCESS - 4},}}"  # runs that can pass
    for name, pattern in (("assign", ASSIGN), ("access", long_access), ("hex", long_hex)):
        rows = rows.withColumn("__m", F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)))
        part = F.regexp_extract_all(F.col("__t"), F.lit(pattern), F.lit(2)) if name == "assign" else None
        rows = rows.withColumn(name, _located("__t", pattern, "__m", part))
    return rows.withColumn("assign", F.filter("assign", lambda s: F.length(s["part"]) >= LEAST_ASSIGNED)).drop("__m")


def _upper(z: Column) -> Column:
    """The normal distribution's upper tail, by the Abramowitz and Stegun approximation 7.1.26 of erfc."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    terms = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    poly = reduce(lambda acc, c: (acc + c) * t, reversed(terms), F.lit(0.0))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _encoding(token: Column) -> Column:
    return F.when(token.rlike("^[0-9a-fA-F]+$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` of ``base_spans`` with ``found``: candidates with encoding, length band and p-value."""
    rows = rows.withColumn("__m", F.regexp_extract_all("__t", F.lit(CANDIDATE), F.lit(0))).withColumn("__c", _located("__t", CANDIDATE, "__m"))
    held = F.concat("assign", "access", "hex")
    apart = F.filter("__c", lambda c: ~F.exists(held, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    rows = rows.withColumn("__c", apart)

    def coded(c: Column) -> Column:
        kind = _encoding(c["value"])
        letters = F.when(kind == "hex", F.lit(ALPHABETS["hex"])).when(kind == "base32", F.lit(ALPHABETS["base32"])).otherwise(F.lit(ALPHABETS["base64"]))
        bare = F.rtrim(F.when(kind == "hex", F.lower(c["value"])).otherwise(F.translate(c["value"], "_-", "/+")), F.lit("="))
        codes = F.transform(F.filter(F.split(bare, ""), lambda x: x != ""), lambda x: F.instr(letters, x) - 1)
        pools = F.array(F.length(F.regexp_replace(bare, "[^A-Z]", "")), F.length(F.regexp_replace(bare, "[^a-z]", "")))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), kind.alias("kind"), F.length(letters).cast("double").alias("k"), pools.alias("pools"), codes.alias("x"))

    rows = rows.withColumn("__c", F.transform("__c", coded))

    def measured(c: Column) -> Column:
        k, x, n = c["k"], c["x"], F.size(c["x"])
        middle = (k - 1) / 2
        squares = F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(0.0), lambda acc, a: acc + F.pow(F.size(F.filter(x, lambda y: y == a)).cast("double"), F.lit(2.0)))
        left, right = F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1)
        serial = F.aggregate(F.zip_with(left, right, lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda acc, y: acc + y)
        changes = F.aggregate(F.zip_with(left, right, lambda a, b: F.when((a > middle) != (b > middle), 1.0).otherwise(0.0)), F.lit(0.0), lambda acc, y: acc + y)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), k.alias("k"), n.cast("double").alias("n"), c["pools"].alias("pools"), squares.alias("squares"), serial.alias("serial"), changes.alias("changes"))

    rows = rows.withColumn("__c", F.filter(F.transform("__c", measured), lambda c: c["n"] >= 16))

    def scored(c: Column) -> Column:
        k, n = c["k"], c["n"]
        free = k - 1
        chi = F.greatest(k / n * c["squares"] - n, F.lit(0.0))
        bell = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))  # Wilson and Hilferty
        upper, lower = c["pools"][0], c["pools"][1]
        three = F.pow(upper - n * 26 / 64, F.lit(2)) / (n * 26 / 64) + F.pow(lower - n * 26 / 64, F.lit(2)) / (n * 26 / 64) + F.pow(n - upper - lower - n * 12 / 64, F.lit(2)) / (n * 12 / 64)
        letters = F.when(c["kind"] == "hex", n * 6 / 16).otherwise(n * 26 / 32)
        two = F.pow(upper + lower - letters, F.lit(2)) * (1 / letters + 1 / (n - letters))
        pooled = F.when(c["kind"] == "base64", F.exp(-three / 2)).otherwise(2 * _upper(F.sqrt(two)))  # two and one degrees
        runs = (2 * c["changes"] - (n - 1)) / F.sqrt(n - 1)
        serial = c["serial"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), F.floor(F.log2(n)).cast("int").alias("band"), F.array(_upper(bell), pooled, 2 * _upper(F.abs(runs)), 2 * _upper(F.abs(serial))).alias("p"))

    rows = rows.withColumn("__c", F.transform("__c", scored))
    whole = F.transform("__c", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["band"].alias("band"), (1 - F.pow(1 - F.array_min(c["p"]), F.lit(4))).alias("p")))
    return rows.withColumn("found", whole).drop("__m", "__c")


def cuts(rows: DataFrame) -> dict[tuple[str, int], float]:
    """The p-value above which candidates count as random, per encoding and length band; none where no cut will do."""
    found = rows.select(F.explode("found").alias("c")).select("c.kind", "c.band", "c.p")
    counts = [F.count_if(F.col("p") > t).alias(f"n{i}") for i, t in enumerate((*CUTS, LAMBDA))]
    out = {}
    for r in found.groupBy("kind", "band").agg(*counts).collect():  # encodings x powers of two
        random = r[f"n{len(CUTS)}"] / (1 - LAMBDA)
        for i, t in enumerate(CUTS):
            accepted = r[f"n{i}"]
            if accepted and 1 - min(accepted, random * (1 - t)) / accepted <= FALSE_SHARE:
                out[r.kind, r.band] = t
                break
    return out


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["order"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``: one row per document.

    ``spans`` lists kind:start:end in code points, ends exclusive, by start and then by kind in the order of ``KINDS``.
    """
    bare = ["assign", "access", "hex"]
    rows = candidates(base_spans(docs.select("doc_id", text), text))
    rows = rows.select("doc_id", *(F.transform(c, lambda s: F.struct(s["start"], s["end"])).alias(c) for c in bare), "found")
    rows = checkpointed(rows)
    taken = cuts(rows)
    cut = F.create_map(*[F.lit(x) for (kind, band), t in taken.items() for x in (f"{kind}:{band}", t)]) if taken else F.create_map().cast("map<string,double>")
    rows = rows.withColumn("random", F.filter("found", lambda c: F.coalesce(c["p"] > F.element_at(cut, F.concat_ws(":", c["kind"], c["band"])), F.lit(False))))

    def ordered(name: str) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(name) + 1).alias("order"), s["end"].alias("end")))

    base = F.concat(*map(ordered, bare))
    counts = [F.size(c).cast("long").alias(f"n_{c}") for c in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(base, ordered("random"))).alias("spans"))
