"""Secret scans by a randomness test battery, in DataFrame operations only.

Three base rules find assignments, access keys and long hex runs. The method adds spans: every long run of key
characters gets an inferred encoding (decimal, hex, base32, letters of one or both cases, base36, base64), and three
tests ask whether its symbols look drawn at random from that alphabet: chi-squared uniformity, a runs test over
character classes (for letters a test of the share of vowels), and lag-1 serial correlation. Their p-values are
combined by Fisher's rule.

False discoveries are controlled with decoys: every document gives some runs that are not secret, made of its own
words (one case, CamelCase, with a number at the end) and of counted-up digits, long enough to be candidates. In a
length band the share of decoys that pass a threshold, (passing + 1) / (decoys + 1), times the band's candidates
estimates how many passing candidates are not random. The least strict threshold is taken at which they are at most
Q of those that pass; a band without enough decoys to show that takes none, so it reports nothing.

Positions are code points, computed from the matches and the gaps between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.session import cut

#: The base rules, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"
KINDS = ("assign", "access", "hex", "random")
#: A candidate of the method: a whole run of key characters of at least MIN_RUN.
MIN_RUN = 20
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}(?![A-Za-z0-9+/_=-])"
#: Thresholds tried for the combined p-value, the strictest first, and the share of false finds allowed.
GRID = (0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.003)
Q = 0.05
#: Vowels of the languages at hand, in either case.
VOWELS = "aeiouyAEIOUY"
#: Upper ends of the length bands.
BANDS = (24, 32, 40, 48, 64, 96, 128)
#: Matches of a text that are placed together.
BLOCK = 256
#: Characters of runs that a task of the battery takes, and a file of their tables.
PART = 1 << 16


def spans(text: Column, pattern: str, whole: Column, kind: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, end, kind, value) of `whole`, the pattern's leftmost non-overlapping matches in text.

    Matches whose `group` is shorter than `least` are dropped after matching, so they still use up their text.
    """
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    pairs = F.zip_with(F.zip_with(gaps, whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("n"))), part, lambda x, v: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), v.alias("value")))
    empty = F.array().cast(SPANS)

    def step(state: Column, x: Column) -> Column:
        a = state["at"] + x["gap"]
        one = F.struct(a.alias("start"), (a + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct((a + x["n"]).alias("at"), F.when(F.length(x["value"]) >= least, F.concat(state["found"], F.array(one))).otherwise(state["found"]).alias("found"))

    def block(state: Column, pairs: Column) -> Column:
        """A block's spans from where the one before it ended; appending copies a block, not all that was found."""
        own = F.aggregate(pairs, F.struct(state["at"].alias("at"), empty.alias("found")), step)
        return F.get(F.transform(F.array(own), lambda x: F.struct(x["at"].alias("at"), F.concat(state["blocks"], F.array(x["found"])).alias("blocks"))), 0)

    blocks = F.get(F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(BLOCK)), lambda i: F.slice(p, i, F.lit(BLOCK)))), 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("blocks"))
    return F.when(F.size(whole) > 0, F.flatten(F.aggregate(blocks, start, block, lambda s: s["blocks"]))).otherwise(empty)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal (a rational approximation, error below 1e-7)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2.0 * 0.3989422804014327 * F.exp(-z * z / 2.0) * poly)


def _class(c: Column, k: Column) -> Column:
    """Digits, lower, upper, others; for letters only vowels and consonants."""
    plain = F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)
    return F.when(k.isin(26.0, 52.0), F.lit(VOWELS).contains(c).cast("int")).otherwise(plain)


def alphabet(value: Column) -> Column:
    """The number of symbols of the inferred encoding."""
    return (
        F.when(value.rlike("^[0-9]+$"), 10.0)
        .when(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$"), 16.0)
        .when(value.rlike("^[a-z_-]+$") | value.rlike("^[A-Z_-]+$"), 26.0)
        .when(value.rlike("^[A-Z2-7]+=*$"), 32.0)
        .when(value.rlike("^[A-Za-z/_-]+$"), 52.0)
        .when(value.rlike("^[0-9a-z_-]+$") | value.rlike("^[0-9A-Z_-]+$"), 36.0)
        .otherwise(64.0)
    )


def battery(found: DataFrame) -> DataFrame:
    """found with n, k, the three p-values and their combination `p`; found has `value`."""
    chars = F.filter(F.split(F.regexp_replace("value", "=+$", ""), ""), lambda c: c != "")
    out = found.withColumn("chars", chars).withColumn("n", F.size("chars").cast("double")).withColumn("k", alphabet(F.col("value")))
    codes = F.transform("chars", lambda c: F.ascii(c).cast("double"))
    out = out.withColumn("codes", codes).withColumn("classes", F.transform("chars", lambda c: _class(c, F.col("k"))))
    tally = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter("chars", lambda x: x == c)).cast("double"), F.lit(2.0)))
    out = out.withColumn("chi", tally * F.col("k") / F.col("n") - F.col("n"))
    # Wilson-Hilferty: a chi-squared value as a normal one; only too much clumping counts against randomness
    d = F.col("k") - 1
    wh = (F.pow(F.greatest(F.col("chi"), F.lit(1e-9)) / d, F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * d))) / F.sqrt(2.0 / (9.0 * d))
    out = out.withColumn("p_chi", F.when(wh <= 0, 1.0).otherwise(normal_tail(wh)))
    changes = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + F.when(F.try_element_at("classes", i) != F.try_element_at("classes", i - 1), 1.0).otherwise(0.0))
    share = F.aggregate(F.array(*[F.lit(x) for x in range(4)]), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter("classes", lambda x: x == c)) / F.col("n"), F.lit(2.0)))
    out = out.withColumn("changes", changes).withColumn("mixed", F.lit(1.0) - share)
    expected = (F.col("n") - 1) * F.col("mixed")
    z = (F.col("changes") - expected) / F.sqrt(F.greatest(expected * F.greatest(1.0 - F.col("mixed"), F.lit(0.05)), F.lit(0.25)))
    # symbols of one class tell nothing of a small alphabet, and much where others were to be expected
    alone = F.when(F.col("k") == 16, F.lit(0.05)).otherwise(F.lit(1e-4))
    # ordinary text keeps to its class, so only too few changes speak against randomness
    runs = F.when(F.col("mixed") < 0.05, alone).when(z >= 0, 1.0).otherwise(normal_tail(z))
    # of random letters 12 in 52 are vowels, of words some two in five
    vowels, chance = F.size(F.filter("classes", lambda x: x == 1)), 12.0 / 52.0
    v = (vowels - F.col("n") * chance) / F.sqrt(F.col("n") * chance * (1 - chance))
    out = out.withColumn("p_runs", F.when(F.col("k").isin(26.0, 52.0), normal_tail(v)).otherwise(runs))
    mean = F.aggregate("codes", F.lit(0.0), lambda s, c: s + c) / F.col("n")
    out = out.withColumn("mean", mean)
    spread = F.aggregate("codes", F.lit(0.0), lambda s, c: s + (c - F.col("mean")) * (c - F.col("mean")))
    cross = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + (F.try_element_at("codes", i) - F.col("mean")) * (F.try_element_at("codes", i - 1) - F.col("mean")))
    r = F.when(spread > 0, cross / spread).otherwise(1.0)
    out = out.withColumn("p_serial", normal_tail((r + 1.0 / F.col("n")) * F.sqrt("n")))
    x = -2.0 * (F.log(F.greatest("p_chi", F.lit(1e-12))) + F.log(F.greatest("p_runs", F.lit(1e-12))) + F.log(F.greatest("p_serial", F.lit(1e-12))))
    return out.withColumn("p", F.exp(-x / 2) * (1 + x / 2 + x * x / 8))  # chi-squared tail, 6 degrees


def band_of(n: Column) -> Column:
    out = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        out = F.when(n <= BANDS[k], k).otherwise(out)
    return out


def decoys_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(value) runs that are no secrets, four a document, from three to seven of its own words at a place that a hash fixes."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z ]+", " "), " +"), lambda w: F.length(w).between(2, 12))
    seeded = docs.select(words.alias("w"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h")).filter(F.size("w") >= 8)
    start = (F.pmod(F.col("h"), F.size("w") - 7) + 1).cast("int")
    some = seeded.select("h", F.slice("w", start, F.pmod(F.shiftright("h", 17), F.lit(5)).cast("int") + 3).alias("w"))
    camel = F.array_join(F.transform("w", lambda x: F.initcap(x)), "")
    first = F.pmod(F.col("h"), F.lit(90)).cast("int") + 10
    counted = F.array_join(F.transform(F.sequence(first, first + F.pmod(F.shiftright("h", 9), F.lit(12)).cast("int") + 9), lambda x: x.cast("string")), "")
    kinds = F.array(camel, F.lower(F.when(F.col("h") % 2 == 0, F.array_join("w", "")).otherwise(F.array_join("w", "_"))), F.concat(camel, F.pmod("h", F.lit(100)).cast("string")), counted)
    return some.select(F.explode(kinds).alias("value")).filter(F.length("value") >= MIN_RUN)


def thresholds(tested: DataFrame) -> dict[int, float]:
    """Per length band, the least strict threshold at which the expected false finds stay under Q; tested: value, p, band, decoy."""
    at = lambda decoy: [F.count_if((F.col("p") >= a) & (F.col("decoy") == decoy)) for a in (0.0, *GRID)]
    out = {}
    for row in tested.groupBy("band").agg(F.array(*at(True)).alias("d"), F.array(*at(False)).alias("t")).collect():  # one row per band
        d, t = row["d"], row["t"]
        allowed = [a for k, a in enumerate(GRID, 1) if t[k] and (d[k] + 1) / (d[0] + 1) * t[0] <= Q * t[k]]
        out[row["band"]] = min(allowed) if allowed else 2.0
    return out


def _parts(read: DataFrame) -> int:
    """How many parts, and so files, hold the runs of read: by their characters, not by the shuffle partitions."""
    chars = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + F.length(r["value"]))
    return (read.agg(F.sum(chars)).head()[0] or 0) // PART + 1


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id and `found`, its spans (start, end, kind, value) by start, then kind.

    Kinds are listed in KINDS' order; "random" is the method's, and a random run that a base span covers is
    not repeated. Null texts count as empty; ends are exclusive; positions count code points. Repeated rows
    give repeated results; other columns are not read; an empty table gives an empty result. Thresholds are
    fixed per run from all candidates and decoys of the whole table, so a text's added spans depend on the others; in
    a table of few documents decoys may not suffice to allow any. Only one row per length band reaches the driver.
    """
    rules = {"assign": (ASSIGN, 2, 8), "access": (ACCESS[:-1] + "{12,}", 0, 1), "hex": ("(?<![0-9a-f])" + HEX[:-1] + "{32,}", 0, 1), "random": (RUN, 0, 1)}
    matched = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    matched = matched.select("doc_id", "_t", *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"_{kind}") for kind, (p, _, _) in rules.items()])
    placed = {kind: spans(F.col("_t"), p, F.col(f"_{kind}"), kind, group, least) for kind, (p, group, least) in rules.items()}
    read = cut(matched.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(placed["assign"], placed["access"], placed["hex"]).alias("base"), placed["random"].alias("runs")), "spans")
    parts = _parts(read)
    values = read.select(F.explode("runs.value").alias("value")).distinct().coalesce(parts)
    judged = lambda found: battery(found).select("value", "p", band_of(F.col("n")).alias("band"))
    tested = cut(judged(values), "tested")
    made = judged(decoys_of(docs, text, doc_id).distinct())  # counted by band and not written
    pass_at = F.lit(2.0)
    for band, least in thresholds(tested.withColumn("decoy", F.lit(False)).unionByName(made.withColumn("decoy", F.lit(True)))).items():
        pass_at = F.when(F.col("band") == band, least).otherwise(pass_at)
    secret = cut(tested.filter(F.col("p") >= pass_at).select(F.col("value").alias("secret")), "secrets")
    # runs go by the number of their row, which is written with it; the base spans follow where a run is secret
    one = read.filter(F.size("runs") > 0).select("row", F.explode("runs").alias("span"))
    kept = cut(one.join(secret, one["span.value"] == secret["secret"]).select("row", "span").coalesce(parts), "random")
    base = read.join(kept.select(F.col("row").alias("_row")).distinct(), F.col("row") == F.col("_row"), "left_semi").select("row", F.explode("base").alias("span"))
    # a run is covered if a base span that starts before it, or with it, ends behind it: the furthest end so far tells
    line = Window.partitionBy("row").orderBy("span.start", F.col("span.kind") == "random").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("span.kind") != "random", F.col("span.end"))).over(line)
    extra = kept.unionByName(base).withColumn("_reach", reach).filter((F.col("span.kind") == "random") & F.coalesce(F.col("_reach") < F.col("span.end"), F.lit(True)))
    extra = extra.groupBy(F.col("row").alias("_row")).agg(F.collect_list("span").alias("random"))
    out = read.join(extra, F.col("row") == F.col("_row"), "left")
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(F.concat("base", F.coalesce("random", F.array().cast(SPANS))), lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return out.select("doc_id", F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))).alias("found"))


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
