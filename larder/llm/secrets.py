"""Secret scan: three patterns, and character Markov models for what no pattern names.

Two first-order character models are trained from labelled samples, one of random strings and one
of ordinary identifiers. A long token is a secret where the mean log-likelihood ratio of its
transitions is above a threshold. Everything is DataFrame functions: positions come from
the lengths of the pieces between matches, the model is one array row of a scalar subquery (its
size is fixed by the alphabet).

Neither a pattern nor a token reaches over a line feed, so a text is scanned by lines, and only those that some pattern
matches are taken apart. Work grows with the length of a text, that of a token with its length; within one line it grows with its spans times its
length.

Defined results: a null text counts as empty and has no spans, and stays null when redacted; very long texts are scanned whole; spans are in code points, end
exclusive; a token that overlaps a span of a pattern is not reported again. Rows may repeat, each has its own result; an empty table gives an empty
one; the columns of the input keep their names whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Matches of HEX and ACCESS that are long enough, found directly: runs are matched whole, so the minimum can stand in the pattern.
LONG_ACCESS, LONG_HEX = f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", f"[0-9a-f]{{{LEAST_HEX},}}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Tokens that the models judge, and the mean log-likelihood ratio from which one counts as random.
LEAST_TOKEN, THRESHOLD = 20, 0.45
TOKEN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}+"
#: Added to each count of a transition.
PRIOR = 0.5
#: Random strings and identifiers of the default labelled sample.
SAMPLE_ROWS = 4000

# Common words of identifiers and of running text, from which ordinary samples are put together.
_WORDS = """
get set add put map list user name file path data code test main init load save read write open close start stop next prev
value index count total order table column query result parse format string number object array buffer stream server client request response
message error warning handler manager service factory builder controller provider context session config option default update delete create insert
select filter group account customer payment product category description information application transaction notification authentication
the and that with from this have which their would there about other these into more some could than first only over also where most through between
der die und das ist nicht ein eine mit sich auch werden auf dem für zur schlag keit heit ung lich verein schaft entwicklung gesellschaft möglichkeit versicherung
que les des une dans pour est pas sur avec plus par sont cette mais comme nous tout fait ment tion eau aux elle ouverture gouvernement développement
los las por una para con del más pero sus como este sobre entre ción dad miento información desarrollo situación actividad universidad
ing ation ness able ence ther ered ently ingly ational tional ouble ending
""".split()


_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Numbers that are added up in one fold, whose result is copied with each of them.
_FOLD = 256


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(numbers: Column, start: Column) -> Column:
    zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(numbers, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def before(numbers: Column) -> Column:
    """For each of the numbers the sum of those before it."""
    slices = lambda ns: F.transform(F.sequence(F.lit(0), F.ceil(F.size(ns) / _FOLD).cast("int") - 1), lambda i: F.slice(ns, i * _FOLD + 1, F.lit(_FOLD)))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n)
    joined = lambda parts: F.flatten(F.zip_with(parts, _running(F.transform(parts, total), F.lit(0)), _running))
    return _let(numbers, lambda ns: F.when(F.size(ns) == 0, F.array().cast("array<int>")).otherwise(_let(slices(ns), joined)))


def _found(line: Column, pattern: str, kind: int, least_value: int = 0) -> Column:
    """The spans of a pattern's matches in a line, from the lengths of the matches and of the pieces between them."""
    values = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1 if least_value else 0)), F.char_length)
    whole = F.zip_with(F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.char_length), values, lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    pieces = F.zip_with(whole, F.transform(F.split(line, pattern, -1), F.char_length), lambda m, gap: F.when(m.isNotNull(), F.struct(gap.alias("gap"), m["n"].alias("n"), m["v"].alias("v"))))
    placed = _let(F.filter(pieces, lambda p: p.isNotNull()), lambda ps: F.zip_with(ps, before(F.transform(ps, lambda p: p["gap"] + p["n"])), lambda p, at: F.struct((at + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + p["gap"] + p["n"]).alias("end"), p["v"].alias("v"))))
    kept = F.filter(placed, lambda s: s["v"] >= least_value)
    return F.when(F.rlike(line, F.lit(pattern)), F.transform(kept, lambda s: F.struct(s["start"], s["kind"], s["end"]))).otherwise(F.array()).cast(_SPANS)


def labelled_samples(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(token, random) samples made by rule: digests in several notations, and words put together as identifiers are."""
    base = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("random "), F.col("id")), 512)
    b64 = F.base64(F.unhex(digest))
    length = (F.lit(20) + F.col("id") % 29).cast("int")
    random = F.expr("id % 4")
    chance = F.when(random == 0, F.substr(b64, F.lit(1), length)).when(random == 1, F.regexp_replace(F.substr(b64, F.lit(3), length), "[+/=]", "")).when(random == 2, F.translate(F.substr(b64, F.lit(5), length), "+/", "-_")).otherwise(F.substr(digest, F.lit(1), length))
    words = F.array(*[F.lit(w.translate(str.maketrans("äöüßéáíóúñ", "aousoaioun"))) for w in _WORDS])
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(_WORDS))).cast("int"))
    parts = [pick(k) for k in range(6)]
    style = F.expr("id % 6")
    plain = (
        F.when(style == 0, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]))
        .when(style == 1, F.concat_ws("_", *parts))
        .when(style == 2, F.concat_ws("-", *parts))
        .when(style == 3, F.upper(F.concat_ws("_", *parts)))
        .when(style == 4, F.concat_ws("/", *parts))
        .otherwise(F.concat(*parts, F.when(F.col("id") % 3 == 0, F.lpad((F.col("id") % 100).cast("string"), 2, "0")).otherwise(F.lit(""))))
    )
    return base.select(chance.alias("token"), F.lit(True).alias("random")).union(base.select(plain.alias("token"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> DataFrame:
    """One row: ``ratio``, the log-likelihood ratio of each transition by code(a) * len(ALPHABET) + code(b)."""
    size = len(ALPHABET)
    code = lambda s, i: F.instr(F.lit(ALPHABET), F.substr(s, i, F.lit(1)))
    pairs = samples.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("token") - 1, F.lit(1))), lambda i: F.struct(code(F.col("token"), i).alias("a"), code(F.col("token"), i + 1).alias("b")))).alias("p"))
    pairs = pairs.where("p.a > 0 and p.b > 0").groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    grid = samples.sparkSession.range(size * size).select((F.expr(f"id div {size}") + 1).cast("int").alias("a"), (F.col("id") % size + 1).cast("int").alias("b"))
    cells = grid.join(pairs, ["a", "b"], "left").fillna(0, ["r", "o"])
    sums = cells.groupBy("a").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    cells = cells.join(sums, "a").select("a", "b", (F.log((F.col("r") + PRIOR) / (F.col("rs") + PRIOR * size)) - F.log((F.col("o") + PRIOR) / (F.col("os") + PRIOR * size))).alias("x"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "x"))), lambda c: c["x"]).alias("ratio"))


def _mean_ratio(token: Column, ratio: Column) -> Column:
    size = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = lambda cs: F.zip_with(F.slice(cs, F.lit(1), F.size(cs) - 1), F.slice(cs, F.lit(2), F.size(cs) - 1), lambda a, b: F.get(ratio, a * size + b))
    return F.aggregate(_let(codes, steps), F.lit(0.0), lambda acc, x: acc + x) / (F.char_length(token) - 1)


def _line_spans(line: Column, ratio: Column, threshold: float) -> Column:
    """All spans of a line, by start and kind."""
    base = F.concat(_found(line, ASSIGN, 0, LEAST_ASSIGN), _found(line, LONG_ACCESS, 1), _found(line, LONG_HEX, 2))

    def with_tokens(known: Column) -> Column:
        alone = lambda t: ~F.exists(known, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"]))
        unlikely = lambda t: _mean_ratio(F.substr(line, t["start"] + 1, t["end"] - t["start"]), ratio) > threshold
        return F.array_sort(F.concat(known, F.filter(_found(line, TOKEN, 3), lambda t: alone(t) & unlikely(t))))

    return _let(base, with_tokens)


def _scanned(docs: DataFrame, model: DataFrame | None, threshold: float) -> DataFrame:
    """``docs`` with ``lines`` of texts that may hold a secret and ``found``, the spans in each of them; null for other texts."""
    model = model if model is not None else train(labelled_samples(docs.sparkSession))
    any_of = F.lit("|".join((ASSIGN, LONG_ACCESS, LONG_HEX, TOKEN)))
    docs = docs.withColumn("ratio", model.scalar()).withColumn("lines", F.when(F.rlike("text", any_of), F.split("text", "\n", -1)))
    spans = lambda line: F.when(F.rlike(line, any_of), _line_spans(line, F.col("ratio"), threshold)).otherwise(F.array().cast(_SPANS))
    return docs.withColumn("found", F.transform("lines", spans)).drop("ratio")


def scan(docs: DataFrame, model: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans for every row of ``docs`` (doc_id, text): arrays of struct<start, kind, end> by start and kind (an index of KINDS)."""
    found = _scanned(docs.select("doc_id", "text"), model, threshold)
    move = lambda spans, at: F.transform(spans, lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end")))
    whole = F.flatten(F.zip_with("found", before(F.transform("lines", lambda n: F.char_length(n) + 1)), move))
    found = found.select("doc_id", F.coalesce(whole, F.array().cast(_SPANS)).alias("spans"))
    return found.select("doc_id", F.filter("spans", lambda s: s["kind"] < 3).alias("base"), "spans")


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind of pattern, the digest of the patterns' spans, and all spans."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def redacted(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark``, and n_chars brought up to date."""
    columns = docs.columns
    named = {c: f"_{i}_{c}" for i, c in enumerate(columns) if c != "text"}
    found = _scanned(docs.select("text", *[F.col(c).alias(n) for c, n in named.items()]), None, THRESHOLD)
    text = F.col("text")

    def clean(line: Column, spans: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            apart = s["start"] >= acc["at"]
            return F.struct(F.when(apart, F.concat(acc["out"], F.substr(line, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substr(line, acc["at"] + 1, F.char_length(line))))).otherwise(line)

    found = found.withColumn("text", F.when(F.exists("found", lambda s: F.size(s) > 0), F.array_join(F.zip_with("lines", "found", clean), "\n")).otherwise(text))
    out = [text if c == "text" else F.char_length("text").cast(dict(docs.dtypes)["n_chars"]).alias(c) if c == "n_chars" else F.col(named[c]).alias(c) for c in columns]
    return found.select(*out)
