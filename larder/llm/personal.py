"""Personal data: four patterns, and terms that give away who is meant, by information theory.

The patterns name protected entities (an address, a number). What else discloses an entity is told by the corpus: of
N documents n_e hold entity e, n_t term t, and in n_te of them t stands within ``WINDOW`` words of a mention of e. The
pointwise mutual information log(N n_te / (n_t n_e)) is what t says about e; log(N / n_e) is all there is to
say. Where their quotient is above ``DISCLOSED``, and t was seen near e in ``LEAST_CONTEXTS`` different
contexts at least (copies of a passage are one), t discloses e, and every document that holds e loses t: it is generalised to its stem
("zorb*") where the stem's own quotient is low enough, else it is removed.

Scale: texts without anything that could match a pattern don't leave the JVM. Co-occurrence is counted in windows, so its rows
grow with the mentions; no pairs of all entities and terms of a document are made. A document's terms meet their entities by
an equi-join on the term, then on the document; common words drop out by an exact bound before words are counted; a term can disclose (N / n_e)^(1 - DISCLOSED) entities at most, as the
quotient bounds its share. All counts are over all rows, with partial sums before each shuffle; intermediate tables hold digests of
entities instead of them.

Defined results: a null text counts as empty and has no spans; texts of any length are taken whole, in time that grows
with them; spans are in code points, end exclusive, by kind and start; kinds may overlap one another, terms never overlap a span of a
pattern. Equal starts of a kind can't be. Repeated rows count each and have their own results; an empty table gives an empty one; doc_id is passed through,
null included; other columns, whatever their names, are ignored (``sanitised`` keeps them).
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of a mention that count as near it, and the code points in which they have to lie.
WINDOW, REACH = 8, 400
#: Share of an entity's information from which a term discloses it, and different contexts that show it.
DISCLOSED, LEAST_CONTEXTS = 0.8, 3
#: Shortest term; letters of a stem, and of the shortest word that has one.
LEAST_TERM, STEM, LEAST_STEMMED = 3, 4, 6
#: Terms up to which their table is broadcast (counted first).
BROADCAST_TERMS = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
#: A text has a span only where this is found; no part of it repeats without an end.
_CANDIDATE = r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]|\+[0-9][\x20().0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[\x20-]?[0-9]){12}"
_SPANS = "array<struct<kind:int,start:int,end:int>>"
_FOUND = f"struct<spans:{_SPANS},entities:array<string>,near:array<struct<entity:string,term:string,context:long>>>"

Span = tuple[int, int, int]


def _emails(text: str) -> list[tuple[int, int]]:
    """An address starts where its run of characters does, or behind the address before; going back from each @ keeps that linear."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append((start, end))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    """Whether the digits, every second one from the right doubled and its own digits summed, sum to a multiple of ten."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _is_card(text: str) -> bool:
    return len(text) < 40 and 13 <= len(digits := _digits(text)) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the four patterns, by kind and start."""
    spans = [(0, *s) for s in _emails(text)]
    spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    spans += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _is_card(m[0])]
    return spans + [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def entity(kind: int, value: str) -> str:
    """The digest of what a span stands for, however it is written."""
    plain = value.lower() if kind == 0 else ".".join(p.lstrip("0") or "0" for p in value.split(".")) if kind == 1 else _digits(value)
    return hashlib.blake2b(f"{KINDS[kind]}:{plain}".encode(), digest_size=16).hexdigest()


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, without overlaps."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _apart(cover: tuple[list[int], list[int]], start: int, end: int) -> bool:
    i = bisect.bisect_left(cover[1], start + 1)
    return i == len(cover[0]) or cover[0][i] >= end


def stem(word: str) -> str | None:
    return f"{word[:STEM]}*" if len(word) >= LEAST_STEMMED else None


def _words(text: str, low: int, high: int, cover: tuple[list[int], list[int]]) -> list[str]:
    """Lower-cased words that lie whole in a stretch of the text, outside of all spans."""
    found = [(m.start() + low, m.end() + low) for m in _WORD.finditer(text[low:high])]
    cut = lambda s, e: (s == low and low > 0 and text[low - 1].isalnum()) or (e == high and high < len(text) and text[high].isalnum())
    return [text[s:e].lower() for s, e in found if _apart(cover, s, e) and not cut(s, e)]


def _hash(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _look(text: str | None) -> tuple:
    """Spans, distinct entities, and the terms near each with one of their contexts."""
    spans = base_spans(text or "")
    cover = _merged(spans)
    near: dict[tuple[str, str], int] = {}
    entities = []
    for kind, start, end in spans:
        entities.append(e := entity(kind, text[start:end]))
        words = _words(text, max(0, start - REACH), start, cover)[-WINDOW:] + _words(text, end, min(len(text), end + REACH), cover)[:WINDOW]
        context = _hash(words)
        for word in words:
            if len(word) >= LEAST_TERM:
                near.setdefault((e, word), context)
                if s := stem(word):
                    near.setdefault((e, s), context)
    return spans, sorted(set(entities)), [(*k, c) for k, c in near.items()]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def looked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, ``spans``, ``entities`` and ``near``, stored; docs has ``text`` (null where there is no span) among columns of its own."""
    look = F.udf(_look, _FOUND, useArrow=True)
    none = F.lit(None).cast(_FOUND)
    hit = F.rlike(_text(), F.lit(_CANDIDATE))
    seen = docs.withColumn("_found", F.when(hit, look(F.when(hit, _text()))).otherwise(none))
    empty = lambda c, kind: F.coalesce(F.col(f"_found.{c}"), F.array().cast(kind)).alias(c)
    others = [c for c in docs.columns if c != "text"]
    seen = seen.select(*others, "text", empty("spans", _SPANS), empty("entities", "array<string>"), empty("near", "array<struct<entity:string,term:string,context:long>>"), F.monotonically_increasing_id().alias("row"))
    return seen


def _document_terms(text: Column) -> Column:
    """Distinct lower-cased words, and the stems of those that have one."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= LEAST_TERM)
    stems = lambda ws: F.transform(F.filter(ws, lambda w: F.char_length(w) >= LEAST_STEMMED), lambda w: F.concat(F.substr(w, F.lit(1), F.lit(STEM)), F.lit("*")))
    return F.get(F.transform(F.array(F.array_distinct(words)), lambda ws: F.concat(ws, F.array_distinct(stems(ws)))), 0)


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """(entity, term, stemmed): terms that disclose an entity, and whether their stem doesn't; None where no term is near one often enough."""
    total = F.lit(float(docs.count()))

    def share(n_t: Column) -> Column:
        told = F.log(total * F.col("n_te") / (n_t * F.col("n_e"))) / F.log(total / F.col("n_e"))
        return F.when(F.col("n_e") < total, told).otherwise(0.0)

    near = found.select(F.explode("near").alias("x")).select("x.*")
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS)
    mentions = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    # A term is in as many documents at least as it is near some entity in: common words are known to disclose nothing without being counted.
    least = found.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["term"]))).alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = pairs.join(mentions, "entity").join(least, "term").where(share(F.col("n_near")) > DISCLOSED)
    pairs = stored(pairs.select("entity", "term", "n_te", "n_e", "n_near"), "personal-pairs")
    terms = pairs.select("term").distinct()
    wanted = terms.count()
    if not wanted:
        return None
    terms = F.broadcast(terms) if wanted <= BROADCAST_TERMS else terms
    counts = docs.select(F.explode(_document_terms(_text())).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(counts, "term", "left").where(share(F.greatest(F.coalesce("n_t", F.lit(0)), "n_near")) > DISCLOSED)
    scored = stored(scored.select("entity", "term"), "personal-scored")
    telling_stems = scored.where(F.col("term").endswith("*")).select("entity", F.col("term").alias("stem"), F.lit(True).alias("tells"))
    own_stem = F.when(F.char_length("term") >= LEAST_STEMMED, F.concat(F.substr("term", F.lit(1), F.lit(STEM)), F.lit("*")))
    words = scored.where(~F.col("term").endswith("*")).withColumn("stem", own_stem)
    return words.join(telling_stems, ["entity", "stem"], "left").select("entity", "term", (F.col("stem").isNotNull() & F.col("tells").isNull()).alias("stemmed"))


def marked(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (text null where it holds no span), ``spans`` of the patterns, and ``terms``: array<struct<term, stemmed>> that the document loses."""
    bound_batches(docs.sparkSession)
    found = looked(docs)
    found = stored(found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "personal-found")
    none = F.array().cast("array<struct<term:string,stemmed:boolean>>")
    keep = [*docs.columns, "spans"]
    flagged = disclosing(docs, found)
    if flagged is None:
        return found.select(*keep, none.alias("terms"))
    held = found.where(F.size("spans") > 0)
    named = held.select("row", F.explode(_document_terms(F.col("text"))).alias("term")).join(flagged, "term")
    theirs = held.select("row", F.explode("entities").alias("entity"))
    lost = named.join(theirs, ["row", "entity"]).groupBy("row", "term").agg(F.min("stemmed").alias("stemmed"))
    lost = lost.groupBy("row").agg(F.collect_list(F.struct("term", "stemmed")).alias("terms"))
    held = held.join(lost, "row", "left").select(*keep, F.coalesce("terms", none).alias("terms"))
    return held.union(found.where(F.size("spans") == 0).select(*keep, none.alias("terms")))


def term_spans(text: str | None, spans: list, terms: list) -> list[Span]:
    """Where a text has the terms, outside of its spans."""
    if not terms:
        return []
    cover, lost = _merged([(s["kind"], s["start"], s["end"]) for s in spans]), {t["term"] for t in terms}
    return [(4, m.start(), m.end()) for m in _WORD.finditer(text) if m[0].lower() in lost and _apart(cover, m.start(), m.end())]


def _python(f: Callable, kind: str) -> Callable:
    return F.udf(f, kind, useArrow=True)


def _plain(values) -> list:  # noqa: ANN001
    """Arrow may hand lists over as arrays, and structs as rows."""
    return [] if values is None else [v if isinstance(v, dict) else v.asDict() for v in (values.tolist() if isinstance(values, np.ndarray) else values)]


def _all_spans(rows: DataFrame) -> Column:
    find = _python(lambda text, spans, terms: term_spans(text, _plain(spans), _plain(terms)), _SPANS)
    some = F.size("terms") > 0
    # Texts go to Python only where there is a term to find.
    extra = find(F.when(some, F.col("text")), F.when(some, F.col("spans")), F.when(some, F.col("terms")))
    return F.concat("spans", F.coalesce(F.when(some, extra), F.array().cast(_SPANS)))


def _written(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by pattern, the digest of the patterns' spans, and all spans with the terms."""
    rows = marked(docs.select("doc_id", "text"))
    rows = rows.select("doc_id", "spans", _all_spans(rows).alias("all"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])], F.sha2(_written("spans"), 256).alias("base_sha256"), _written("all").alias("spans"))


def _clean(text: str | None, spans, terms) -> str | None:  # noqa: ANN001
    """The text with marks for spans (overlapping ones as one, by the first's kind) and terms as stems or marks."""
    base, lost = [(s["kind"], s["start"], s["end"]) for s in _plain(spans)], {t["term"]: t["stemmed"] for t in _plain(terms)}
    if text is None or not base:
        return text
    starts, ends = _merged(base)
    kinds = {start: kind for kind, start, _ in sorted(base, reverse=True)}
    found = [(s, e, f"<{KINDS[kinds[s]].upper()}>") for s, e in zip(starts, ends, strict=True)]
    found += [(s, e, stem(text[s:e]) if lost[text[s:e].lower()] else "<TERM>") for _, s, e in term_spans(text, _plain(spans), _plain(terms))]
    out, at = [], 0
    for s, e, mark in sorted(found):
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by marks and disclosing terms generalised or removed; all other columns stay."""
    names = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns) if c != "text"}
    # The text is kept beside the one that is null without spans.
    rows = marked(docs.select(F.col("text").cast("string").alias("text"), F.col("text").alias("_whole"), *[F.col(c).alias(n) for c, n in names.items()]))
    some = F.size("spans") > 0
    text = F.when(some, _python(_clean, "string")(F.when(some, F.col("text")), F.when(some, F.col("spans")), F.when(some, F.col("terms")))).otherwise(F.col("_whole"))
    return rows.withColumn("_clean", text).select(*[F.col("_clean").alias("text") if c == "text" else F.col(names[c]).alias(c) for c in docs.columns])
