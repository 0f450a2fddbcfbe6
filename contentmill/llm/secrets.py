"""Secret scans: fixed forms, and strings that read like noise to Markov models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmill.llm.spans import count, gated, joined, spans, tagged

# The base forms.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
ASSIGN_LEAST = 12

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Runs of the alphabet from this length on are judged by the models.
RUN_LEAST = 16
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{RUN_LEAST},}}+"
#: Transitions of a run that are scored together.
CHUNK = 16_384
#: A run is a secret from this log-likelihood ratio in all and for each transition.
RATIO_LEAST, RATIO_MEAN = 9.0, 0.35

# Word parts of ordinary identifiers.
PARTS = (
    "get set add new old max min sum key map log run user name value index count list table column row file path read write open close "
    "start end first last next order group filter join load save parse format string number date time event token page text source target "
    "request response handler service client server config option default error message buffer stream thread queue cache node tree graph "
    "the and for that with this from have ation ment able ing ver heit keit lich ung schaft tion eur elle ement cion mente dad "
    "http org com www html img css jpg static assets public private internal abstract factory builder manager provider adapter exception "
    "world house water light night people school country company market system control process network project report history between "
    "through without however general national question possible although straße gegen zwischen werden können nicht einer pour dans avec "
    "être cette toujours porque también cuando nosotros entonces siempre"
).split()


def samples(spark: SparkSession, n: int = 8000) -> DataFrame:
    """Labelled training strings (body, random): encoded digests, and joined word parts."""
    seed = F.sha2(F.col("id").cast("string"), 256)
    words = F.array(*[F.lit(w) for w in PARTS])

    def word(i: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PARTS))) + 1).cast("int"))

    def camel(i: int) -> Column:
        return F.initcap(word(i))

    digest = F.base64(F.unhex(seed))
    bare = F.translate(digest, "+/=", "")
    kinds = [digest, seed, F.upper(seed), F.translate(digest, "+/=", "-_"), F.substring(digest, 5, 24), bare, bare, F.substring(bare, 3, 20), F.lower(bare), F.upper(bare)]
    noise = F.element_at(F.array(*kinds), (F.pmod("id", F.lit(len(kinds))) + 1).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(10**9)).cast("string")
    forms = [
        F.concat_ws("_", word(1), word(2), word(3), word(4)),
        F.concat(word(1), camel(2), camel(3), camel(4)),
        F.concat(camel(1), camel(2), camel(3), word(4)),
        F.concat_ws("-", word(1), word(2), word(3), word(4)),
        F.upper(F.concat_ws("_", word(1), word(2), word(3))),
        F.concat(word(1), word(2), word(3), word(4), word(5)),
        F.concat_ws("/", word(1), word(2), word(3), F.pmod("id", F.lit(2100)).cast("string")),
        F.repeat(F.element_at(F.array(*map(F.lit, "-_+/")), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")), 24),
        F.concat(number, number, number),
        F.concat_ws("-", number, word(1), number),
        F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 2), F.substring(number, 7, 2)),
        F.concat(camel(1), F.substring(number, 1, 1), camel(2), F.substring(number, 2, 2)),
    ]
    plain = F.element_at(F.array(*forms), (F.pmod("id", F.lit(len(forms))) + 1).cast("int"))
    ids = spark.range(n)
    return ids.select(noise.alias("body"), F.lit(True).alias("random")).unionByName(ids.select(plain.alias("body"), F.lit(False).alias("random")))


def _places(body: Column) -> Column:
    """Alphabet places (1-based) of a string's characters; 0 for others."""
    return F.transform(F.split(body, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def train_markov(labelled: DataFrame) -> list[float]:
    """Log ratios of transition probabilities, random over ordinary.

    ``labelled`` has body (string) and random (boolean); rows with a null are ignored.
    Counts are grouped by Spark; at most the square of the alphabet's size comes to the
    driver. Add-one smoothing; without samples of a class its transitions are uniform.
    The value of a pair (i, j) of places is at ``i * (len(ALPHABET) + 1) + j``.
    """
    k = len(ALPHABET) + 1
    places = labelled.where("body is not null and random is not null").select("random", _places(F.col("body")).alias("p"))
    pairs = places.select("random", F.explode(F.expr("transform(filter(sequence(1, size(p)), i -> i < size(p)), i -> p[i - 1] * %d + p[i])" % k)).alias("pair"))
    counts = {False: [1.0] * (k * k), True: [1.0] * (k * k)}
    for row in pairs.groupBy("random", "pair").count().collect():
        counts[row["random"]][row["pair"]] += row["count"]

    def log_p(c: list[float], i: int) -> float:
        row = i // k * k
        return math.log(c[i] / sum(c[row : row + k]))

    return [round(log_p(counts[True], i) - log_p(counts[False], i), 6) for i in range(k * k)]


def markov_ratio(body: Column, model: Column) -> Column:
    """Log-likelihood ratio of a string over all its transitions, ``CHUNK`` of them at a time."""
    k = len(ALPHABET) + 1

    def of(part: Column) -> Column:
        places = _places(part)
        last = F.size(places)
        steps = F.zip_with(F.slice(places, F.lit(1), last - 1), F.slice(places, F.lit(2), last - 1), lambda a, b: a * k + b)
        return F.aggregate(steps, F.lit(0.0), lambda total, pair: total + F.element_at(model, pair + 1))

    parts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(body) - 2) / CHUNK).cast("int"), F.lit(0)))
    return F.aggregate(parts, F.lit(0.0), lambda total, i: total + of(F.substring(body, i * CHUNK + 1, F.lit(CHUNK + 1))))


def reads_like_noise(body: Column, model: Column) -> Column:
    long_enough = F.length(body) >= RUN_LEAST
    return F.when(long_enough, markov_ratio(body, model) >= F.greatest(F.lit(RATIO_LEAST), RATIO_MEAN * (F.length(body) - 1))).otherwise(False)


def _noisy_parts(run: Column, model: Column) -> Column:
    """(start, end) within a run: the whole, or else its parts between slashes, that read like noise."""

    def step(state: Column, part: Column) -> Column:
        here = F.array(F.struct(state["at"].alias("start"), (state["at"] + F.length(part)).alias("end")))
        return F.struct((state["at"] + F.length(part) + 1).alias("at"), F.when(reads_like_noise(part, model), F.concat(state["out"], here)).otherwise(state["out"]).alias("out"))

    kind = "array<struct<start:int,end:int>>"
    parts = F.aggregate(F.split(run, "/"), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda state: state["out"])
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(run).alias("end")))
    return F.when(reads_like_noise(run, model), whole).when(F.contains(run, F.lit("/")), parts).otherwise(F.array().cast(kind))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text, one row per input row, without a shuffle.

    Columns: the id, the text, ``assign``, ``access``, ``hex`` and ``markov`` (arrays of
    spans, in order). The first three are fixed forms, leftmost and non-overlapping by
    kind. ``markov`` has runs of ``RUN_LEAST`` or more letters, digits and + / _ - (so a
    value is judged apart from its name and ``=``, and dotted parts one by one) for which
    the model of random strings is likelier than the one of ordinary identifiers; of a run
    that isn't, parts between slashes. What one fixed form covers whole isn't repeated.

    A null text is empty and has no spans; repeated rows are each scanned; a null id
    stays null; other columns are ignored; an empty table gives an empty result.
    """
    model = train_markov(samples(docs.sparkSession) if labelled is None else labelled)
    ratios = F.from_json(F.lit("[" + ",".join(map(str, model)) + "]"), "array<double>")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = base.withColumns(
        {
            "m_assign": gated(F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")), ASSIGN),
            "m_access": gated(F.contains("text", F.lit("AKIA")), ACCESS),
            "m_hex": F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
            "m_run": F.regexp_extract_all("text", F.lit(RUN), F.lit(0)),
        }
    )
    # Used more than once, so computed once; texts without a noisy run need no positions.
    found = found.withColumn("noisy", F.when(F.size("m_run") > 0, F.transform("m_run", lambda m: _noisy_parts(m, ratios))))
    placed = found.select(
        "id",
        "text",
        spans("text", "m_assign", ASSIGN).alias("s_assign"),
        spans("text", "m_access", ACCESS).alias("s_access"),
        spans("text", "m_hex", HEX).alias("s_hex"),
        F.when(F.exists("noisy", lambda n: F.size(n) > 0), F.zip_with(spans("text", "m_run", RUN), "noisy", lambda s, n: F.transform(n, lambda x: F.struct((s["start"] + x["start"]).alias("start"), (s["start"] + x["end"]).alias("end"))))).alias("s_run"),
    )
    long_enough = F.filter("s_assign", lambda s: F.length(F.regexp_extract(s["body"], ASSIGN, 2)) >= ASSIGN_LEAST)
    kinds = placed.select("id", "text", tagged(long_enough, "assign", 0).alias("assign"), tagged(F.col("s_access"), "access", 1).alias("access"), tagged(F.col("s_hex"), "hex", 2).alias("hex"), "s_run")
    covered = lambda s: F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    fresh = F.filter(F.flatten("s_run"), lambda s: ~covered(s))
    return kinds.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "assign", "access", "hex", tagged(F.when(F.col("s_run").isNotNull(), fresh), "markov", 3).alias("markov"))


def secret_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.concat("assign", "access", "hex")
    return scanned.select(
        id_col,
        count(F.col("assign")).alias("n_assign"),
        count(F.col("access")).alias("n_access"),
        count(F.col("hex")).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, "markov")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """``docs`` with every found secret replaced by ``mask``; all columns stay.

    Overlapping spans are replaced once. Texts without a secret stay as they are.
    """
    scanned = scan_secrets(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_all"), F.col(text_col).alias("_text")), id_col="_all", text_col="_text")
    all_spans = F.array_sort(F.concat("assign", "access", "hex", "markov"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        piece = F.when(fresh, F.concat(F.substring(F.col("_text"), state["at"] + 1, span["start"] - state["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    cut = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    tail = F.col("_cut")
    masked = F.when(F.size("_spans") == 0, F.col("_text")).otherwise(F.concat(F.array_join(tail["out"], ""), F.substring(F.col("_text"), tail["at"] + 1, F.length("_text"))))
    done = scanned.withColumn("_spans", all_spans).withColumn("_cut", F.when(F.size("_spans") > 0, cut)).withColumn("_masked", masked)
    return done.select(*[(F.when(F.col("_all")[c].isNull(), F.lit(None)).otherwise(F.col("_masked")) if c == text_col else F.col("_all")[c]).alias(c) for c in docs.columns])
