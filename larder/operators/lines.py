"""Ingredient lines to quantity, range, unit, item and note.

``simple`` reads quantity, unit and note from the start and end of the line, as written. ``modular`` takes the line apart into
tokens, consumes quantity and unit by place, names units canonically and moves adjectives (in their base form), purposes and closing phrases into
the note. ``legacy`` reads unit and notes off what follows a quantity, also where there is none. ``auto`` is ``simple``, line by line
replaced by ``legacy`` where the first has found nothing, and says so. ``split`` is the oldest form.
All of it is Column expressions, so a parse stays inside code generation and next to the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.lexicon import CLOSING_PHRASES, KIND_COLOURS, Lexicon, any_of, lexicon
from larder.functions.notes import quantity_token, remainder
from larder.functions.quantity import number, quantity_range
from larder.functions.text import let, normalize_line, normalize_quantity, prenormalize, squeeze, sub
from larder.functions.tokens import ARTICLES, HALVES, parsed_head, tidy
from larder.functions.units import ACTIVE_UNITS, SIMPLE_UNITS, leading_unit

_HALF = rf"(?iu)^(?:(?:{'|'.join(ARTICLES)})\s+)?(?:{'|'.join(HALVES)})\s+"
#: A hyphened piece behind a word; a note in brackets, which may hold one pair more.
_PIECE = r"(?iu)(?<=\p{L})\s*-\s*st(?:ü|ue|u)ck\b"
_BRACKETS = r"\s*\(((?:[^()]|\([^()]*\))*)\)"
#: Words before a colon at the start that are a note.
_OPENING = r"(?iu)^(optional|wahlweise|alternativ)\s*:\s*(?=\S)"
#: How the lexicon writes that an adjective takes the endings of cases.
_CASES = "(e|er|es)?"
DIAGNOSES = ("zero_denominator", "nothing_found")
FIELDS = ("qty_low", "qty_high", "is_range", "unit", "item", "note")


def normalized(raw: Column) -> Column:
    """The line as the simple engine sees it."""
    return normalize_quantity(prenormalize(normalize_line(raw)))


def _closing_note(text: Column) -> Column:
    """struct(item, note) of a text that ends in brackets without others in them; the note is null without."""

    def one(x: Column) -> Column:
        inside = F.substring_index(x["t"], "(", -1)
        closed = x["t"].contains("(") & (F.locate(")", inside) == F.char_length(inside)) & (F.char_length(inside) > 1)
        before = F.rtrim(F.substr(x["t"], F.lit(1), F.char_length(x["t"]) - F.char_length(inside) - 1))
        return F.struct(F.when(closed, before).otherwise(x["t"]).alias("item"), F.when(closed, F.trim(F.rtrim(inside, F.lit(")")))).alias("note"))

    return let(F.struct(F.trim(text).alias("t")), one)


def parse_simple(df: DataFrame, raw: str = "raw", units: tuple[str, ...] = ACTIVE_UNITS) -> DataFrame:
    """``df`` with qty_low, qty_high, is_range, unit, item and note of its column ``raw``. A null line is null throughout."""
    keep = df.columns
    # Stages, not one nested expression: each is used several times by the next.
    df = df.withColumn("_line", prenormalize(normalized(F.col(raw))))
    df = df.withColumn("_half", F.when(F.col("_line").rlike(_HALF), F.trim(sub(F.col("_line"), _HALF, "")))).withColumn("_q", quantity_range(F.col("_line")))
    found = F.col("_half").isNotNull() | F.col("_q.low").isNotNull()
    df = df.withColumn("_u", F.when(found, leading_unit(F.coalesce("_half", "_q.rest"), units)).otherwise(F.struct(F.lit(None).cast("string").alias("unit"), F.col("_line").alias("rest"))))
    df = df.withColumn("_n", _closing_note(F.col("_u.rest")))
    is_half = F.col("_half").isNotNull()
    return df.select(
        *keep,
        F.when(is_half, 0.5).otherwise(F.col("_q.low")).alias("qty_low"),
        F.when(~is_half, F.col("_q.high")).alias("qty_high"),
        (~is_half & F.col("_q.high").isNotNull()).alias("is_range"),
        F.col("_u.unit").alias("unit"),
        F.col("_n.item").alias("item"),
        F.col("_n.note").alias("note"),
    )


def parse_modular(df: DataFrame, raw: str = "raw", locale: str = "de", overlay: Lexicon | None = None) -> DataFrame:
    """The columns of ``parse_simple`` from tokens: canonical units, ordered ranges, words of half, ``piece`` for a bare count of what can be counted.

    Notes come in the order of the line: what stands before a colon, a leading TK, leading adjectives, a hyphened "Stück", purposes and closing
    phrases, adjectives at the end or behind a comma, brackets. Adjectives are taken by the longest phrase of the lexicon, and noted without their ending; a line of nothing but adjectives keeps
    the last as item.
    """
    words = lexicon(locale, overlay)
    adjectives = tuple(a for a in words["adjectives"] if a not in KIND_COLOURS)
    adjective, every = any_of(adjectives), any_of(words["adjectives"])
    purpose, closing = any_of(words["purpose_phrases"]), any_of(CLOSING_PHRASES)
    end = r"(?![\p{L}\p{M}-])"
    df = df.withColumn("_line", tidy(F.col(raw))).withColumn("_saft", free_text_half(F.col("_line")))
    opened = F.trim(F.regexp_extract("_line", _OPENING, 1))
    df = df.withColumn("_opened", F.lower(opened)).withColumn("_h", parsed_head(F.coalesce("_saft.item", sub(F.col("_line"), _OPENING, ""))))
    brackets = F.transform(F.regexp_extract_all("_h.rest", F.lit(_BRACKETS), F.lit(1)), lambda b: squeeze(sub(sub(F.replace(b, F.lit(")"), F.lit("")), r"^\s*\(", ""), r"\s*\(\s*", ", ")))
    df = df.withColumn("_brackets", F.array_join(brackets, ", ")).withColumn("_item", squeeze(sub(F.col("_h.rest"), _BRACKETS, " ")))
    df = df.withColumn("_item", sub(F.col("_item"), r"\s+(?=[,;.])|^[^\p{L}\p{N}]+|[^\p{L}\p{N}%.-]+$", ""))
    clove = F.col("_h.unit").isNull() & F.col("_h.low").isNotNull() & F.col("_item").rlike(r"(?iu)^knoblauchzehen?\b")
    df = df.withColumn("_clove", F.coalesce(clove, F.lit(False)))
    df = df.withColumn("_item", F.when(F.col("_clove"), sub(F.col("_item"), r"(?iu)^knoblauchzehen?\b", "Knoblauch")).when(F.col("_h.unit") == "clove", sub(F.col("_item"), r"(?iu)\bzehen?\b\s*(?=\S)", "")).otherwise(F.col("_item")))

    def take(name: str, pattern: str, note: int, rest: str) -> None:
        """Move group ``note`` of a pattern over the item into a column, and leave ``rest``."""
        nonlocal df
        df = df.withColumn(name, F.trim(F.regexp_extract("_item", pattern, note))).withColumn("_item", squeeze(sub(F.col("_item"), pattern, rest)))

    take("_tail", rf"(?iu)^(.*?),\s*((?:{every}|{purpose}|{closing}|optional){end}.*)$", 2, "$1")
    take("_frozen", rf"(?u)^(TK){end}\s*(?=\S)", 1, "")
    take("_piece", _PIECE, 0, "")
    take("_closing", rf"(?iu)(?<=\S)\s+({closing})$", 1, "")
    take("_purpose", rf"(?iu)(?<=\S)\s+({purpose}){end}", 1, " ")
    take("_lead", rf"(?iu)^((?:{adjective}\s+)+)(?=\S)", 1, "")
    take("_trail", rf"(?iu)(?<=\S)((?:\s+{adjective})+)$", 1, "")
    base = lambda text: F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf"(?iu)({every}){end}"), F.lit(1)), _base_form(words["adjectives"])), ", ")
    only_adjectives = rf"(?iu)^(?:{every}\s*)+$"
    tail = F.when(F.col("_tail").rlike(only_adjectives), base(F.col("_tail"))).otherwise(F.col("_tail"))
    piece = F.when(F.col("_piece") != "", "Stück").otherwise("")
    found = [F.col("_opened"), F.col("_saft.note"), F.col("_frozen"), base(F.col("_lead")), piece, F.col("_purpose"), F.col("_closing"), base(F.col("_trail")), tail, F.col("_brackets")]
    notes = F.array_distinct(F.filter(F.array(*[F.coalesce(n, F.lit("")) for n in found]), lambda n: n != ""))
    item = F.when(F.col("_line").isNotNull(), F.trim(F.col("_item")))
    uncountable = F.lower("item_").rlike(rf"(?iu)^(?:{any_of(words['uncountable_nouns'])}){end}")
    df = df.withColumn("item_", item)
    counted = F.col("_h.low").isNotNull() & F.col("item_").rlike(r"^(?!x\s*\d)\p{L}") & ~uncountable
    low = F.when(F.col("_saft").isNotNull(), F.col("_saft.qty")).otherwise(F.col("_h.low"))
    unit = F.coalesce("_saft.unit", "_h.unit", F.when(F.col("_clove"), "clove"), F.when(counted, "piece"))
    out = df.select(
        "*", low.alias("qty_low_"), F.col("_h.high").alias("qty_high_"), unit.alias("unit_"), F.when(F.size(notes) > 0, F.array_join(notes, ", ")).alias("note_"),
    )
    given = [c for c in out.columns if c in df.columns[: df.columns.index("_line")]]
    return out.select(*given, F.col("qty_low_").alias("qty_low"), F.col("qty_high_").alias("qty_high"), F.col("qty_high_").isNotNull().alias("is_range"), F.col("unit_").alias("unit"), F.col("item_").alias("item"), F.col("note_").alias("note"))


def _base_form(adjectives: tuple[str, ...]) -> Callable[[Column], Column]:
    """Adjectives in lower case without the ending of their case, which the lexicon's patterns end with; phrases and words that have none stay."""
    inflected = any_of(tuple(a.removesuffix(_CASES) for a in adjectives if a.endswith(_CASES)))
    return lambda adjective: let(F.lower(squeeze(adjective)), lambda a: F.when(a.rlike(rf"(?u)^{inflected}(?:e|er|es)$"), sub(a, "(?:er|es|e)$", "")).otherwise(a))


def parse_legacy(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Quantity or range at the start, then unit, item and notes of what follows it: brackets, what stands behind the first comma, TK and hyphened pieces."""
    line = quantity_token(F.col(raw))
    staged = df.withColumn("_line", line).withColumn("_q", quantity_range(F.col("_line")))
    staged = staged.withColumn("_r", remainder(F.coalesce("_q.rest", "_line")))
    high = F.col("_q.high")
    return staged.select(*df.columns, F.col("_q.low").alias("qty_low"), high.alias("qty_high"), high.isNotNull().alias("is_range"), F.col("_r.unit").alias("unit"), F.col("_r.item").alias("item"), F.col("_r.note").alias("note"))


def parse_split(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The oldest split into quantity, unit and name; ranges keep the lower bound, and notes stay in the name."""
    line = normalize_quantity(prenormalize(F.col(raw)))
    staged = df.withColumn("_q", quantity_range(line)).withColumn("_line", line)
    staged = staged.withColumn("_u", F.when(F.col("_q.low").isNotNull(), leading_unit(F.col("_q.rest"), SIMPLE_UNITS)))
    return staged.select(*df.columns, F.col("_q.low").alias("qty_low"), F.lit(None).cast("double").alias("qty_high"), F.lit(False).alias("is_range"), F.col("_u.unit").alias("unit"), F.coalesce("_u.rest", "_line").alias("item"), F.lit(None).cast("string").alias("note"))


def verdict(line: Column, low: Column, unit: Column, item: Column) -> Column:
    """What is wrong with the first engine's result for a normalized line: one of DIAGNOSES, or null."""
    zero = line.rlike(r"^\s*(?:\d+\s+)?\d+\s*/\s*0+(?!\d)")
    nothing = low.isNull() & unit.isNull() & (F.coalesce(item, F.lit("")).isin("") | (F.lower(item) == F.lower(line)))
    return F.when(line.isNull(), None).when(zero, DIAGNOSES[0]).when(nothing, DIAGNOSES[1])


def parse_auto(df: DataFrame, raw: str = "raw", first: Callable[..., DataFrame] = parse_simple) -> DataFrame:
    """The first engine, and ``legacy`` for the lines that it fails on, with ``engine`` and ``diagnosis`` for each line.

    Both are expressions over the same row, and the second is evaluated for failed lines only: there is no second scan, join or union, and
    a line that one engine can't take ends no query. Count ``diagnosis`` for the fallbacks of a table.
    """
    keep = df.columns
    parsed = first(df, raw)
    staged = parsed.select(*[F.col(c) for c in keep], F.struct(*FIELDS).alias("_first"))
    staged = staged.withColumn("_seen", normalized(F.col(raw)))
    staged = staged.withColumn("diagnosis", verdict(F.col("_seen"), F.col("_first.qty_low"), F.col("_first.unit"), F.col("_first.item")))
    # A null line costs nothing: only lines with a diagnosis are given to the second engine.
    staged = staged.withColumn("_failed", F.when(F.col("diagnosis").isNotNull(), F.col("_seen")))
    both = parse_legacy(staged, "_failed")
    failed = F.col("diagnosis").isNotNull()
    chosen = [F.when(failed, F.col(f)).otherwise(F.col(f"_first.{f}")).alias(f) for f in FIELDS]
    return both.select(*keep, *chosen, F.when(failed, "legacy").otherwise("first").alias("engine"), "diagnosis")


def parse_lines(df: DataFrame, raw: str = "raw", engine: str = "simple") -> DataFrame:
    """Parse with the engine named, with the columns of FIELDS; ``mod`` is ``simple``. Use ``parse_auto`` for what ``auto`` has fallen back on."""
    engines = {"simple": parse_simple, "mod": parse_simple, "modular": parse_modular, "legacy": parse_legacy, "split": parse_split, "auto": parse_auto}
    if engine not in engines:
        raise ValueError(f"unknown engine {engine!r}")
    return engines[engine](df, raw).select(*df.columns, *FIELDS)


def free_text_half(line: Column) -> Column:
    """struct(qty, unit, item, note) of lines like "Saft einer halben Zitrone": half a piece, the first word as note."""
    pattern = r"(?iu)^(saft|schale|abrieb)\s+(?:von\s+)?(?:ein(?:er|em|e)?\s+)?halben?\s+(.*)$"
    hit = line.rlike(pattern)
    return F.when(hit, F.struct(F.lit(0.5).alias("qty"), F.lit("piece").alias("unit"), F.regexp_extract(line, pattern, 2).alias("item"), F.regexp_extract(line, pattern, 1).alias("note")))


def ambiguous(line: Column) -> Column:
    """Whether a line tells neither a quantity at its start nor half of something in words."""
    return let(quantity_token(line), lambda t: quantity_range(t)["low"].isNull() & free_text_half(t).isNull())


def quantity_of(token: Column) -> Column:
    """The number a quantity token stands for."""
    return number(normalize_quantity(prenormalize(token)))
