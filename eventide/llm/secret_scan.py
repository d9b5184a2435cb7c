"""Secret scanning: fixed patterns, and runs of characters that pass a randomness test battery.

Patterns (base spans): assignments to secret names, access keys, long hex. The battery looks at every other run of at least
20 key characters, those of letters or digits alone included. It infers the encoding (decimal, hex, base26, base32, base36,
base52, base64), then tests the symbols against what that encoding gives at random: chi-squared of the counts, runs above and
below the middle, lag-one serial correlation. A run that any test rejects (Bonferroni over three) is not random. Short runs of
ordinary text can pass for lack of length, so each run also gets a p-value under ordinary text of its family: symbol counts at
least as even, and neighbours that differ in the family's way at least as often (letters of one case: two consonants; digits:
more than one apart; else: another class of character), as in the corpus's own runs that the battery rejects, for a text of
that length. Within each encoding and length octave these p-values pass a false-discovery (step-up) control; what is left is
a secret. A random run of one case of letters or of digits alone carries less evidence per character and needs more of them.

All of it is DataFrame expressions. The step-up is done on binned p-values, a run counted at its bin's upper edge, so no
ranking over all rows is needed and the control can only be stricter.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import blank_text, settle

#: The patterns, in the order in which their kinds are listed, and the least length of a match or of its value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16, "hex": 32}

RUN = r"[A-Za-z0-9+/_-]{20,}"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {  # name: (pattern, alphabet); the first that fits is taken
    "decimal": (r"^[0-9]+$", "0123456789"),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789ABCDEF"),
    "base26": (r"^([a-z]+|[A-Z]+)$", LETTERS),
    "base32": (r"^[A-Z2-7]+$", LETTERS + "234567"),
    "base36": (r"^([a-z0-9]+|[A-Z0-9]+)$", "0123456789" + LETTERS),
    "base52": (r"^[A-Za-z]+$", LETTERS + LETTERS.lower()),
    "base64": (r".", LETTERS + LETTERS.lower() + "0123456789+/"),
}
CASED = ("base52", "base64")
FAMILY = {"decimal": "digits", "base26": "letters"}  # all others: mixed
#: Fixed values, which stand in while a corpus has few runs of a family: sums of squared and cubed symbol shares of ordinary
#: text (digits: numbers padded with zeros), the share of neighbours that differ in the family's way, and the weight of these.
PRIORS = {"mixed": (0.066, 0.0065, 0.1), "letters": (0.066, 0.0065, 0.32), "digits": (0.2, 0.067, 0.4)}
PRIOR_WEIGHT = 1000.0


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (a rational approximation in the body, the asymptote beyond five)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-a * a / 2) * 0.3989422804014327
    up = F.when(a > 5, density / a * (1 - 1 / (a * a))).otherwise(density * poly)
    return F.when(z >= 0, up).otherwise(1 - up)


def _occurrences(docs: DataFrame) -> DataFrame:
    """A row per match: id, text key, kind, start, end (code points), match. Matches that are too short are there too."""
    def found(kind: int, pattern: str) -> Column:
        between = F.transform(F.split("_text", pattern, -1), lambda x: F.length(x))
        return F.struct(F.lit(kind).alias("kind"), F.arrays_zip(between.alias("gap"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias("match")).alias("all"))

    patterns = (ASSIGN, ACCESS, HEX, RUN)
    rows = docs.select("_id", "_key", F.explode(F.array(*(found(k, p) for k, p in enumerate(patterns)))).alias("f"))
    rows = rows.select("_id", "_key", "f.kind", F.posexplode("f.all").alias("n", "one"))
    rows = rows.select("_id", "_key", "kind", "n", F.col("one")[rows.schema["one"].dataType.names[0]].alias("gap"),
                       F.col("one")[rows.schema["one"].dataType.names[1]].alias("match")).filter("match is not null").distinct()
    line = Window.partitionBy("_id", "_key", "kind").orderBy("n")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(line).cast("long"))
    return rows.select("_id", "_key", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match")


def _symbols(runs: DataFrame) -> DataFrame:
    """Encoding and test statistics of each run."""
    name = F.coalesce(*(F.when(F.col("match").rlike(p), F.lit(e)) for e, (p, _) in ENCODINGS.items()))
    runs = runs.withColumn("encoding", name).withColumn(
        "s", F.when(F.col("encoding").isin(*CASED), F.translate("match", "-_", "+/")).otherwise(F.upper("match")))
    alphabet = F.create_map(*(x for e, (_, a) in ENCODINGS.items() for x in (F.lit(e), F.lit(a))))[F.col("encoding")]
    runs = runs.withColumn("alphabet", alphabet).withColumns({"k": F.length("alphabet").cast("double"), "n": F.length("s").cast("double")})
    values = F.transform(F.split("s", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double"))
    runs = runs.withColumns({
        "counts": F.transform(F.split("alphabet", ""), lambda c: F.length("s") - F.length(F.replace(F.col("s"), c, F.lit("")))),
        "v": F.filter(values, lambda x: x > 0)})
    squares = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    runs = runs.withColumns({"squares": squares, "m": mean, "high": F.size(F.filter("v", lambda x: x > F.col("k") / 2)).cast("double")})
    shifted = F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = runs.withColumns({
        "spread": F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))),
        "along": F.aggregate(shifted, F.lit(0.0), lambda a, x: a + (x["a"] - F.col("m")) * (x["b"] - F.col("m"))),
        "sides": 1 + F.aggregate(shifted, F.lit(0.0), lambda a, x: a + ((x["a"] > F.col("k") / 2) != (x["b"] > F.col("k") / 2)).cast("double"))})
    n, k, one = F.col("n"), F.col("k"), 2 * F.col("high") * (F.col("n") - F.col("high"))
    chi = k / n * F.col("squares") - n
    sides_var = one * (one - n) / (n * n * (n - 1))
    runs = runs.withColumns({
        "chi": chi,
        "z_chi": (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n),
        "z_runs": F.when(sides_var > 0, (F.col("sides") - 1 - one / n) / F.sqrt(sides_var)).otherwise(F.lit(99.0)),
        "z_serial": F.when(F.col("spread") > 0, (F.col("along") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))})
    family = F.coalesce(*(F.when(F.col("encoding") == e, F.lit(f)) for e, f in FAMILY.items()), F.lit("mixed"))
    # separators have no class: translate drops characters beyond the replacement's length
    classes = F.translate("match", LETTERS + LETTERS.lower() + "0123456789+/-_", "A" * 26 + "a" * 26 + "0" * 10)
    classes = F.replace(classes, F.lit("Aa"), F.lit("aa"))  # a capital at the head of small letters is how words are written
    sounds = F.translate("s", LETTERS, "".join("V" if c in "AEIOUY" else "C" for c in LETTERS))
    steps = (F.when(F.col("family") == "digits", F.size(F.filter(shifted, lambda x: F.abs(x["a"] - x["b"]) > 1)))
             .when(F.col("family") == "letters", F.length(F.replace(sounds, F.lit("V"), F.lit(""))) - F.size(F.filter(F.split(sounds, "V+"), lambda x: x != "")))
             .otherwise(F.greatest(F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1, F.lit(0))))
    pairs = F.when(F.col("family") == "mixed", F.greatest(F.length(classes) - 1, F.lit(0))).otherwise(F.length("s") - 1)
    return runs.withColumn("family", family).withColumns({"steps": steps.cast("double"), "pairs": pairs.cast("double")})


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """One row per document: doc_id, spans array<struct<start, kind, end>> by start, then kind (0 to 3 for KINDS).

    Ends are exclusive, in code points. A null text is empty and has no spans. Repeated rows each get their spans; an id may
    repeat with other texts or be null. Runs inside a base span are not reported again.
    """
    rows = keyed(docs, doc_id, text)
    spans = spans_of(rows, alpha, fdr)
    a, b = rows.select("_id", "_key").alias("a"), spans.alias("b")
    return a.join(b, F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._key") == F.col("b._key")), "left").select(
        F.col("a._id").alias(doc_id), F.coalesce("b.spans", F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")).alias("spans"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _text, and _key, which tells texts of the same id apart."""
    return docs.select(F.col(doc_id).alias("_id"), blank_text(text).alias("_text")).withColumn(
        "_key", F.struct(F.xxhash64("_text").alias("h"), F.length("_text").alias("n")))


def spans_of(rows: DataFrame, alpha: float, fdr: float) -> DataFrame:
    """_id, _key and spans of the keyed texts that have any."""
    found = settle(_occurrences(rows), "matches")
    value = F.length(F.regexp_extract("match", ASSIGN, 2))
    base = found.filter((F.col("kind") == 0) & (value >= LEAST["assign"]) | (F.col("kind") == 1) & (F.length("match") >= LEAST["access"])
                        | (F.col("kind") == 2)).withColumn("match", F.lit(None).cast("string"))
    before = Window.partitionBy("_id", "_key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    marked = base.unionByName(found.filter(F.col("kind") == 3)).withColumn(
        "covered", F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before))
    asked = marked.filter((F.col("kind") == 3) & (F.coalesce("covered", F.lit(0)) < F.col("end")))
    random = _discovered(asked.drop("covered"), alpha, fdr)
    spans = base.select("_id", "_key", "start", "kind", "end").unionByName(random.select("_id", "_key", "start", "kind", "end"))
    return spans.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("spans"))


def _ordinary(rejected: DataFrame) -> DataFrame:
    """A row per family: squares and cubes of the symbol shares, and the share of steps, in the runs that are not random.

    Of mixed runs only those of letters and separators count, less the separators. Keys that pass the battery have no say.
    """
    plain = rejected.filter((F.col("family") != "mixed") | ~F.col("match").rlike("[0-9]")).withColumn("match", F.translate("match", "+/-_", ""))
    symbols = plain.select("family", F.explode(F.split("match", "")).alias("c")).filter("c <> ''").groupBy("family", "c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    shares = symbols.groupBy("family").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.pow("n", F.lit(3.0))).alias("n3"))
    walked = plain.groupBy("family").agg(F.sum("steps").alias("steps"), F.sum("pairs").alias("pairs"))
    priors = F.array(*(F.struct(F.lit(f).alias("family"), *(F.lit(x).alias(c) for x, c in zip(p, ("p2", "p3", "ps"), strict=True))) for f, p in PRIORS.items()))
    rows = rejected.sparkSession.range(1).select(F.inline(priors)).join(shares, "family", "left").join(walked, "family", "left")
    n, w = F.coalesce("n", F.lit(0.0)), PRIOR_WEIGHT

    def blend(power: str, by: Column, prior: str) -> Column:
        return (F.coalesce(F.col(power) / by, F.lit(0.0)) + w * F.col(prior)) / (n + w)
    return rows.select(
        "family", blend("n2", F.col("n"), "p2").alias("q2"), blend("n3", F.col("n") * F.col("n"), "p3").alias("q3"),
        ((F.coalesce("steps", F.lit(0.0)) + w * F.col("ps")) / (F.coalesce("pairs", F.lit(0.0)) + w)).alias("change"))


def _discovered(runs: DataFrame, alpha: float, fdr: float) -> DataFrame:
    worst = F.greatest(_tail(F.col("z_chi")) * -1, _tail(F.abs("z_runs")) * -2, _tail(F.abs("z_serial")) * -2) * -1
    judged = settle(_symbols(runs).select("_id", "_key", "start", "kind", "end", "encoding", "family", "n", "squares", "steps", "pairs", "match",
                                          (3 * worst >= alpha).alias("random")), "judged")
    ordinary = settle(_ordinary(judged.filter("not random")), "ordinary")  # a row per family
    tested = judged.join(F.broadcast(ordinary), "family")
    n, q2, q3 = (F.col(c) for c in ("n", "q2", "q3"))
    # mean and variance of the sum of squared counts when symbols come with the shares of ordinary text
    mean = n * (n - 1) * q2 + n
    var = F.greatest(4 * n * (n - 1) * (n - 2) * q3 + 2 * n * (n - 1) * q2 - 2 * n * (n - 1) * (2 * n - 3) * q2 * q2, F.lit(1e-9))
    even = (mean - F.col("squares")) / F.sqrt(var)
    often = (F.col("steps") - F.col("pairs") * F.col("change")) / F.sqrt(F.greatest(F.col("pairs") * F.col("change") * (1 - F.col("change")), F.lit(1e-9)))
    p = F.when(F.col("random"), F.greatest(_tail((even + often) / F.sqrt(F.lit(2.0))), F.lit(1e-30))).otherwise(F.lit(1.0))
    tested = tested.withColumns({
        "p": p, "octave": F.floor(F.log2("n"))}).withColumn("bin", F.floor(-20 * F.log10("p")).cast("int"))
    tested = settle(tested.select("_id", "_key", "start", "kind", "end", "encoding", "octave", "bin", "random"), "tested")
    stratum = Window.partitionBy("encoding", "octave")
    bins = tested.groupBy("encoding", "octave", "bin").agg(F.count(F.lit(1)).alias("c"))
    bins = bins.withColumns({"all": F.sum("c").over(stratum), "upto": F.sum("c").over(stratum.orderBy(F.desc("bin")))})
    cut = settle(bins.filter(F.pow(F.lit(10.0), -F.col("bin") / 20) <= fdr * F.col("upto") / F.col("all")).groupBy("encoding", "octave").agg(
        F.min("bin").alias("least_bin")), "cuts")  # a row per encoding and octave of length
    return tested.join(cut, ["encoding", "octave"]).filter((F.col("bin") >= F.col("least_bin")) & F.col("random"))


def names(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end, comma-joined."""
    kept = F.filter(spans, lambda x: x["kind"] < 3) if base_only else spans
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", mark: str = "[secret]",
           alpha: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one); ``length`` follows the new text.

    Documents without spans come out as they went in, null texts included.
    """
    spans = spans_of(keyed(docs, doc_id, text), alpha, fdr).alias("s")
    rows = docs.withColumns({"_id": F.col(doc_id), "_key": F.struct(F.xxhash64(blank_text(text)).alias("h"), F.length(blank_text(text)).alias("n"))}).alias("d")
    hit = rows.join(spans, F.col("d._id").eqNullSafe(F.col("s._id")) & (F.col("d._key") == F.col("s._key")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    built = F.aggregate("s.spans", start, lambda acc, x: F.struct(
        F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substr(F.col(f"d.{text}"), acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit(mark)))
        .otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at")),
        lambda acc: F.concat(acc["out"], F.substr(F.col(f"d.{text}"), acc["at"].cast("int") + 1)))
    new = F.when(F.col("s.spans").isNull(), F.col(f"d.{text}")).otherwise(built)
    out = hit.select(*(new.alias(c) if c == text else F.col(f"d.{c}") for c in docs.columns))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text).cast(docs.schema[length].dataType)))
    return out
