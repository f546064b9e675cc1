"""Personal data (operator 7), with DataFrame functions only: patterns, and information-theoretic sanitisation around them.

Patterns find e-mail addresses, IP addresses, card and phone numbers. A protected entity is such a value, and also what values
share: their kind, an e-mail's domain, an address's networks, a card's issuer, a phone's dialling prefixes; values mostly occur once.
The method asks which terms outside the values give an entity away: over the corpus, pointwise mutual information compares how many
documents hold both with how many hold either. A term whose information about the entity is at least `disclosure` of the entity's
own information content, log2(N / documents with it), is a span of kind "term" wherever it stands in a document with that entity.

Terms and entities are counted by 64-bit hashes. Texts that are equal word for word are one row with a count of copies, so a group of
copies costs its distinct texts, and support counts different texts exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Tables

KINDS = ("email", "ip", "card", "phone", "term")
#: Fixed patterns of the contract. Possessive forms and the look-behind change no match, but make long runs linear and free of
#: recursion: the part before "@" and the first digits of an address begin at their run's start, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[\p{L}\p{N}_]++"


@dataclass(frozen=True)
class Disclosure:
    """Different texts that must show the pair, share of the entity's information, least letters of a term."""

    support: int = 3
    disclosure: float = 0.9
    letters: int = 3


def _places(text: str, pattern: str, valid: str = "true") -> str:
    """SQL for array<struct<start,end,value>> of the valid matches in code points; gaps between matches and matches alternate.

    pattern is SQL. Matches that are not valid leave the array as it is, so the fold is linear in them.
    """
    return f"""
      aggregate(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (g, m) -> named_struct('g', char_length(g), 'value', m)),
        named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,value:string>>)),
        (a, s) -> if(s.value is null, a, named_struct('at', a.at + s.g + char_length(s.value),
          'out', if({valid}, array_append(a.out, named_struct('start', a.at + s.g, 'end', a.at + s.g + char_length(s.value), 'value', s.value)), a.out))),
        a -> a.out)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str) -> str:
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(s.value, '[.]'), q -> coalesce(try_cast(q as int) <= 255, false))"
    if kind == "phone":
        return f"char_length({digits}) between 9 and 15"
    if kind == "card":
        doubled = f"aggregate(sequence(1, char_length({digits})), 0, (a, i) -> a + element_at(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring(reverse({digits}), i, 1) as int) + 1 + if(i % 2 = 0, 10, 0)))"
        return f"if(char_length({digits}) between 12 and 19, {doubled} % 10 = 0, false)"
    return "true"


def base_spans(text: str) -> Column:
    """array<struct<start,end,k,value>> sorted by start and kind, for a SQL expression of a text that is not null."""
    found = []
    for k, kind in enumerate(KINDS[:4]):
        hint = f"contains({text}, '{HINTS[kind]}')" if HINTS[kind] else f"{text} rlike '[0-9]'"
        spans = f"transform({_places(text, _quoted(PATTERNS[kind]), _valid(kind))}, s -> named_struct('start', s.start, 'k', {k}, 'end', s.end, 'value', s.value))"
        found.append(f"if({hint}, {spans}, cast(array() as array<struct<start:int,k:int,end:int,value:string>>))")
    return F.expr(f"array_sort(concat({', '.join(found)}))")


#: What a value shares with others of its kind, besides the kind: SQL for strings, by kind (fixed lengths of networks and prefixes).
SHARED = {
    "email": ["substring_index(lower(s.value), '@', -1)"],
    "ip": ["substring_index(s.value, '.', 2)", "substring_index(s.value, '.', 3)"],
    "card": ["left(regexp_replace(s.value, '[^0-9]', ''), 6)"],
    "phone": ["left(regexp_replace(s.value, '[^0-9]', ''), 3)", "left(regexp_replace(s.value, '[^0-9]', ''), 6)"],
}


def _entities() -> str:
    """SQL for the array of protected entities of a span s, as strings."""
    shared = " ".join(f"when {k} then array({', '.join(f'concat({k}, {chr(39)}/{n}:{chr(39)}, {x})' for n, x in enumerate(SHARED[kind]))})" for k, kind in enumerate(KINDS[:4]))
    return f"concat(array(concat(s.k, ''), concat(s.k, ':', lower(s.value))), case s.k {shared} end)"


def _terms(text: str, config: Disclosure) -> str:
    """SQL for the distinct terms of a text, hashed."""
    return f"array_distinct(transform(filter(regexp_extract_all({text}, {_quoted(TERM)}, 0), x -> char_length(x) >= {config.letters}), x -> xxhash64(lower(x))))"


def found_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, base, hidden): mark tells texts apart; hidden is the text of documents with base spans, with the values blanked."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("mark"), "text", base_spans("text").alias("base"))
    # A value becomes as many spaces, so places stay; one that begins inside an earlier one adds what stands out of it.
    hidden = """aggregate(base, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end, 'out', array_append(array_append(a.out, substring(text, a.at + 1, greatest(s.start - a.at, 0))), repeat(' ', s.end - greatest(s.start, a.at))))),
        a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"""
    return rows.select("id", "mark", "base", F.expr(f"if(size(base) > 0, {hidden}, null)").alias("hidden"))


def telling_terms(docs: DataFrame, texts: DataFrame, config: Disclosure, text_col: str, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """telling(entity, term), the pairs above the disclosure threshold, and held(mark, entity): who holds entities that can have any.

    texts(mark, copies, entities, terms) has a row per different text with entities. A term's documents are all with it, inside values too.
    """
    held = texts.select("mark", "copies", F.explode("entities").alias("entity"))
    known = held.groupBy("entity").agg(F.sum("copies").alias("with_entity"), F.count("*").alias("shown")).where(F.col("shown") >= config.support)
    known = tables.stored(known.select("entity", "with_entity"), "known")  # others cannot reach the support with any term
    held = tables.stored(held.join(known.select("entity"), "entity"), "held")
    both = held.join(texts.select("mark", "terms"), "mark").select("entity", "copies", F.explode("terms").alias("term"))
    pairs = both.groupBy("entity", "term").agg(F.sum("copies").alias("together"), F.count("*").alias("texts")).where(F.col("texts") >= config.support)
    pairs = tables.stored(pairs.select("entity", "term", "together"), "pairs")
    asked = tables.stored(pairs.select("term").distinct(), "asked")
    said = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    spread = docs.select(said).select(F.explode(F.expr(_terms("text", config))).alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("with_term"))
    n = F.lit(float(docs.count()))
    own = F.log2(n / F.col("with_entity"))
    mutual = F.log2(n * F.col("together") / (F.col("with_term") * F.col("with_entity")))
    told = pairs.join(known, "entity").join(spread, "term").where((own > 0) & (mutual >= config.disclosure * own))
    return tables.stored(told.select("entity", "term"), "telling"), held.select("mark", "entity")


def personal_spans(docs: DataFrame, config: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, base, spans): base and all spans as array<struct<start,k,end,value>>, in code points, end exclusive; k counts KINDS.

    A row per row of docs; a null text is an empty one. Terms do not overlap base spans. Rows that repeat an id are told apart by
    their text. Other columns are not read.
    """
    tables = Tables(docs.sparkSession)
    found = tables.stored(found_in(docs, id_col, text_col), "found")
    entities = f"array_distinct(transform(flatten(transform(base, s -> {_entities()})), e -> xxhash64(e)))"
    texts = found.where("hidden is not null").groupBy("mark").agg(F.count("*").alias("copies"), F.first("base").alias("base"), F.first("hidden").alias("hidden"))
    texts = tables.stored(texts.select("mark", "copies", F.expr(entities).alias("entities"), F.expr(_terms("hidden", config)).alias("terms"), "hidden"), "texts")
    telling, held = telling_terms(docs, texts, config, text_col, tables)
    mine = held.join(telling.select("entity").distinct(), "entity").join(texts.select("mark", "terms"), "mark").select("mark", "entity", F.explode("terms").alias("term"))
    hits = mine.join(telling, ["entity", "term"], "left_semi").groupBy("mark").agg(F.collect_set("term").alias("hits"))
    # The words of a text that are hits, as they are spelled there, make the pattern that finds their places.
    said = f"array_distinct(filter(regexp_extract_all(hidden, {_quoted(TERM)}, 0), x -> array_contains(hits, xxhash64(lower(x)))))"
    marked = hits.join(texts.select("mark", "hidden"), "mark").withColumn("said", F.expr(said))
    pattern = marked.withColumn("p", F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join("said", "|"), F.lit(r")(?![\p{L}\p{N}_])")))
    extra = f"transform({_places('hidden', 'p')}, s -> named_struct('start', s.start, 'k', 4, 'end', s.end, 'value', lower(s.value)))"
    extra = tables.stored(pattern.select("mark", F.expr(extra).alias("extra")), "extra")
    tables.drop(but=(found, extra))
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int,value:string>>)")
    all_ = found.select("id", "mark", "base").join(extra, "mark", "left")
    return all_.select(F.col("id").alias(id_col), "mark", "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({kinds}), s.k + 1), ':', s.start, ':', s.end)), ',')")


def sanitised(docs: DataFrame, config: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of text_col generalised to its kind in brackets; a span that begins inside an earlier one goes with it."""
    spans = personal_spans(docs, config, id_col, text_col).select(F.col(id_col).alias("_i"), F.col("mark").alias("_m"), F.col("spans").alias("_s")).dropDuplicates(["_i", "_m"])
    same = F.col(id_col).eqNullSafe(F.col("_i")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_m"))
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    text = f"""aggregate(_s, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, s) -> if(s.start < a.at, named_struct('at', greatest(a.at, s.end), 'out', a.out),
          named_struct('at', s.end, 'out', array_append(a.out, concat(substring({text_col}, a.at + 1, s.start - a.at), element_at(array({kinds}), s.k + 1))))),
        a -> concat(array_join(a.out, ''), substring({text_col}, a.at + 1)))"""
    return docs.join(spans, same, "left").withColumn(text_col, F.expr(f"if({text_col} is null, null, {text})")).select(*docs.columns)
