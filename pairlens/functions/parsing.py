"""Answer, confidence and JSON extraction from raw model text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.functions.labels import collapse, label_normalize, let, strip

EMPTY_HIT = "struct<answer:string,parse_method:string,matched_text:string,segment:string>"


def text_clean(text: Column) -> Column:
    """Unix line ends, no byte-order mark, no code fences, no markdown marks."""
    text = F.coalesce(text, F.lit(""))
    # Plain substring tests keep the regular expressions away from texts that do not need them.
    unix = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    marked = F.replace(unix, F.lit("\ufeff"), F.lit(""))
    fenced = F.contains(text, F.lit("```"))
    plain = F.when(fenced, F.regexp_replace(marked, K.CODE_FENCE_PATTERN, "")).otherwise(marked)
    return F.translate(strip(plain), "*_`~", "")


def option_text_fold(text: Column) -> Column:
    """Lower case, punctuation to blanks, whitespace collapsed: the form option texts are compared in."""
    return collapse(F.regexp_replace(F.lower(text_clean(text)), K.OPTION_PUNCTUATION_PATTERN, " "))


def segments(text: Column) -> Column:
    """Search order of an answer: last lines, line tails, last sentences, then the whole text."""
    return let(text_clean(text), segments_of)


def segments_of(normal: Column) -> Column:
    """The same for text that is already clean."""

    def parts(text: Column, pattern: str, n: int) -> Column:
        kept = F.filter(F.transform(F.split(text, pattern), strip), lambda part: part != "")
        return let(kept, lambda all_: F.when(F.size(all_) > n, F.slice(all_, -n, n)).otherwise(all_))

    def ordered(lines: Column) -> Column:
        tails = F.transform(
            F.filter(F.array(*[F.lit(n) for n in (5, 4, 3, 2)]), lambda n: n <= F.size(lines)),
            lambda n: F.array_join(F.slice(lines, -n, n), "\n"),
        )
        sentences = F.reverse(parts(normal, K.SENTENCE_END_PATTERN, 3))
        return F.concat(F.reverse(lines), tails, sentences, F.array(strip(normal)))

    found = let(parts(normal, K.LINE_BREAK_PATTERN, 5), ordered)
    return F.array_distinct(F.filter(found, lambda part: part != ""))


def _hit(answer: Column, method: Column | str, matched: Column, segment: Column) -> Column:
    method = F.lit(method) if isinstance(method, str) else method
    return F.struct(
        F.upper(answer).alias("answer"), method.alias("parse_method"), matched.alias("matched_text"),
        segment.alias("segment"),
    ).cast(EMPTY_HIT)


def _phrases(strict: bool) -> list[tuple[str, str]]:
    tail = r"(?![A-Za-z0-9])" if strict else ""
    return [(m, p if m == "json_answer_key" else p + tail) for m, p in K.ANSWER_PATTERNS]


def _phrase_hit(segment: Column, strict: bool) -> Column:
    found = None
    for method, pattern in _phrases(strict):
        hit = _hit(
            F.regexp_extract(segment, pattern, 1), method, F.regexp_extract(segment, pattern, 0), segment
        )
        found = (F if found is None else found).when(segment.rlike(pattern), hit)
    # One scan for the words that every pattern needs saves the twelve searches on most segments.
    return F.when(segment.rlike(K.ANSWER_WORDS_PATTERN), found)


def _line_hit(segment: Column) -> Column:
    pattern = K.STANDALONE_LINE_PATTERN
    return F.when(
        segment.rlike(pattern),
        _hit(F.regexp_extract(segment, pattern, 1), "standalone_line",
             F.regexp_extract(segment, pattern, 0), segment),
    )


def _option_hit(segment: Column, folded: Column) -> Column:
    """``folded``: array of (label, text, folded text) of the usable options."""
    named = let(
        option_text_fold(segment), lambda plain: F.filter(folded, lambda o: F.contains(plain, o["folded"]))
    )
    return let(named, lambda found: F.when(
        F.size(found) == 1,
        _hit(F.get(found, F.lit(0))["label"], "option_text_match", F.get(found, F.lit(0))["text"],
             F.lit(None).cast("string")),
    ))


def _token_hit(segment: Column) -> Column:
    def search(condensed: Column) -> Column:
        found = F.regexp_extract_all(condensed, F.lit(K.SINGLE_TOKEN_PATTERN), F.lit(1))
        return let(found, lambda tokens: F.when(
            F.size(tokens) == 1,
            _hit(F.get(tokens, F.lit(0)), "fallback_single_token", F.get(tokens, F.lit(0)), condensed),
        ))

    # Visible characters alone already rule long segments out; only short ones are collapsed.
    short = F.char_length(F.translate(segment, K.WHITESPACE, "")) <= K.SINGLE_TOKEN_MAX_CHARS
    return F.when(short, let(collapse(segment), lambda condensed: F.when(
        F.char_length(condensed) <= K.SINGLE_TOKEN_MAX_CHARS, search(condensed)
    )))


def usable_options(options: Column) -> Column:
    entries = F.transform(
        F.map_entries(options),
        lambda e: F.struct(
            label_normalize(e["key"]).alias("label"), e["value"].alias("text"),
            option_text_fold(e["value"]).alias("folded"),
        ),
    )
    return F.filter(
        entries,
        lambda o: o["label"].isNotNull() & (F.char_length(o["folded"]) >= K.OPTION_TEXT_MIN_CHARS),
    )


def find_hit(parts: Column, options: Column | None = None, strict: bool = False) -> Column:
    """First hit over an array of segments; every stage sees all segments before a weaker stage starts."""
    nothing = F.lit(None).cast(EMPTY_HIT)

    def walk(stage) -> Column:
        return F.aggregate(parts, nothing, lambda hit, s: F.when(hit.isNotNull(), hit).otherwise(stage(s)))

    stages = [walk(lambda s: _phrase_hit(s, strict)), walk(_line_hit)]
    if options is not None:
        # Option texts are folded only for rows that get this far.
        stages.append(let(usable_options(options), lambda usable: F.when(
            F.size(usable) > 0, walk(lambda s: _option_hit(s, usable))
        )))
    stages.append(walk(_token_hit))
    return F.coalesce(*stages)


def describe_hit(hit: Column, normalized: Column, strict: bool = False) -> Column:
    """Answer, status, method, matched text, span and normalised text of a hit."""
    start = None
    for method, pattern in (
        *_phrases(strict),
        ("standalone_line", K.STANDALONE_LINE_PATTERN),
        ("fallback_single_token", K.SINGLE_TOKEN_PATTERN),
    ):
        offset = F.regexp_instr(hit["segment"], F.lit(pattern)) - 1
        start = (F if start is None else start).when(hit["parse_method"] == method, offset)
    return F.struct(
        hit["answer"].alias("answer"),
        F.when(hit["answer"].isNotNull(), "success").otherwise("failed").alias("parse_status"),
        hit["parse_method"].alias("parse_method"),
        hit["matched_text"].alias("matched_text"),
        start.alias("span_start"),
        (start + F.char_length(hit["matched_text"])).alias("span_end"),
        normalized.alias("normalized_text"),
    )


def answer_extract(text: Column, options: Column | None = None, strict: bool = False) -> Column:
    """``find_hit`` and ``describe_hit`` of one text column.

    With ``strict`` a phrase may not end inside a word; by default "the answer depends" gives D.
    """
    return describe_hit(find_hit(segments(text), options, strict), text_clean(text), strict)


def parse_answer(text: Column, options: Column | None = None, strict: bool = False) -> Column:
    """The answer label only."""
    return find_hit(segments(text), options, strict)["answer"]


def with_answers(
    df: DataFrame, text: str, options: str | None = None, strict: bool = False, prefix: str = ""
) -> DataFrame:
    """Add the parsed columns to a table. Segments are projected once and read by every stage."""
    staged = df.withColumn("_normal", text_clean(F.col(text))).withColumn("_parts", segments_of(F.col("_normal")))
    hit = find_hit(F.col("_parts"), None if options is None else F.col(options), strict)
    parsed = staged.withColumn("_hit", hit).withColumn(
        "_parsed", describe_hit(F.col("_hit"), F.col("_normal"), strict)
    )
    fields = ("answer", "parse_status", "parse_method", "matched_text", "span_start", "span_end",
              "normalized_text")
    return parsed.withColumns(
        {prefix + f: F.col("_parsed")[f] for f in fields}
        | {prefix + "confidence": confidence_extract(F.col(text))}
    ).drop("_normal", "_parts", "_hit", "_parsed")


def confidence_extract(text: Column) -> Column:
    """Integer after ``CONFIDENCE:``, limited to 0-100."""
    digits = F.regexp_extract(text, K.CONFIDENCE_PATTERN, 1)
    return F.when(digits != "", F.least(F.greatest(digits.try_cast("int"), F.lit(0)), F.lit(100)))


def raw_answer_fallback(text: Column) -> Column:
    """``ANSWER: X`` anywhere, else the first standalone letter."""
    named = F.upper(F.regexp_extract(text, K.SIMPLE_ANSWER_PATTERN, 1))
    letter = F.regexp_extract(F.upper(strip(text)), K.SIMPLE_LETTER_PATTERN, 1)
    return F.when(named != "", named).when(letter != "", letter)


def json_block(text: Column, default: str = "{}") -> Column:
    """The JSON object that is the whole text, else the outermost ``{...}`` block, else ``default``."""

    def as_object(candidate: Column) -> Column:
        parsed = F.try_parse_json(candidate)
        return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)

    stripped = strip(text)
    return F.coalesce(
        as_object(stripped),
        as_object(F.regexp_extract(stripped, K.JSON_BLOCK_PATTERN, 0)),
        F.try_parse_json(F.lit(default)),
    )


def clamp_score(value: Column, default: float = 0.0) -> Column:
    """Number limited to [0, 1]; ``default`` when it is not a number."""
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(default)), F.lit(0.0)), F.lit(1.0))


def clamp_confidence(value: Column, default: int = 0) -> Column:
    """Number rounded half-even to an integer in [0, 100]; ``default`` when it is not a number."""
    rounded = F.rint(value.try_cast("double"))
    limited = F.least(F.greatest(rounded, F.lit(0.0)), F.lit(100.0)).cast("int")
    # greatest() skips nulls, so a missing number has to be tested first.
    return F.when(rounded.isNull() | F.isnan(rounded), F.lit(default)).otherwise(limited)


def strip_confidence(text: Column) -> Column:
    """The text without its CONFIDENCE lines."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.upper(strip(line)).startswith("CONFIDENCE:"))
    return strip(F.array_join(kept, "\n"))


def short_text(text: Column, limit: int = 120) -> Column:
    """Whitespace collapsed; longer texts cut to ``limit`` characters including the dots."""
    plain = collapse(text)
    return F.when(F.char_length(plain) <= limit, plain).otherwise(
        F.concat(F.substring(plain, 1, limit - 3), F.lit("..."))
    )
