"""Labels, alias lookup and emptiness tests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.constants import OPTION_LABELS, WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every Unicode whitespace character, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Every run of whitespace becomes one blank, both ends trimmed."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def label_normalize(value: Column) -> Column:
    """Trimmed upper-case option label; null for anything outside A-E."""
    label = F.upper(strip(value))
    # Labels that are clean already skip the trimming.
    return F.when(value.isin(*OPTION_LABELS), value).when(label.isin(*OPTION_LABELS), label)


def first_present(fields: Column, names: Sequence[str]) -> Column:
    """Value of the first key that exists in a map column, even when that value is null."""
    chosen = F.when(F.map_contains_key(fields, names[0]), fields[names[0]])
    for name in names[1:]:
        chosen = chosen.when(F.map_contains_key(fields, name), fields[name])
    return chosen


def first_key(record: Column, names: Sequence[str], as_type: str = "string") -> Column:
    """The same lookup on a VARIANT object: a JSON null counts as present."""
    chosen = None
    for name in names:
        found = F.variant_get(record, f"$.{name}", "variant").isNotNull()
        value = F.try_variant_get(record, f"$.{name}", as_type)
        chosen = F.when(found, value) if chosen is None else chosen.when(found, value)
    return chosen


def json_kind(record: Column, path: str) -> Column:
    """JSON type of a VARIANT member (``STRING``, ``BOOLEAN``, ``OBJECT<...>``, ``VOID`` for null)."""
    return F.schema_of_variant(F.variant_get(record, path, "variant"))


def is_json_true(record: Column, name: str) -> Column:
    """True only for the JSON boolean ``true``; text or numbers do not count."""
    return F.coalesce(
        (json_kind(record, f"$.{name}") == "BOOLEAN")
        & F.try_variant_get(record, f"$.{name}", "boolean"),
        F.lit(False),
    )


def is_json_false(value: Column) -> Column:
    """True only for the JSON boolean ``false`` held in a VARIANT column."""
    return F.coalesce(
        (F.schema_of_variant(value) == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean"),
        F.lit(False),
    )


def empty_text(value: Column) -> Column:
    """Null or blank text."""
    return value.isNull() | (strip(value) == "")


def empty_container(value: Column) -> Column:
    """Null or zero-length array or map."""
    return value.isNull() | (F.size(value) == 0)


def empty_json(value: Column) -> Column:
    """Null, blank string, empty array or empty object in a VARIANT column; a string that reads ``[]`` is not empty."""
    text = F.try_variant_get(value, "$", "string")
    hollow = F.when(F.schema_of_variant(value) == "STRING", strip(text) == "").otherwise(text.isin("[]", "{}"))
    return F.coalesce(value.isNull() | F.is_variant_null(value) | hollow, F.lit(True))


def opinion_answer(opinion: Column) -> Column:
    """Answer held by an opinion that is either plain text or an object with ``answer``."""
    return F.when(
        F.schema_of_variant(opinion).startswith("OBJECT"),
        F.try_variant_get(opinion, "$.answer", "string"),
    ).otherwise(F.try_variant_get(opinion, "$", "string"))


#: A family's name with its version and size, as published.
SIZED_NAME = r"Qwen[0-9.]+-[0-9.]+B"


def name_shorten(model: Column, names: Mapping[str, str] | None = None) -> Column:
    """Display name of a model: that of ``names`` where it has one, else by family; the size is the one that a name states."""
    stated = F.regexp_extract(model, SIZED_NAME, 0)
    shown = (
        F.when(stated != "", stated).when(F.contains(model, F.lit("Qwen")), F.lit("Qwen2.5-3B"))
        .when(F.contains(model, F.lit("Phi")), F.lit("Phi-3.5-mini"))
        .when(F.contains(F.lower(model), F.lit("gemma")), F.lit("Gemma2-2B"))
        .otherwise(model)
    )
    for full, short in (names or {}).items():
        shown = F.when(model == full, F.lit(short)).otherwise(shown)
    return shown


def dataset_shorten(dataset: Column) -> Column:
    return F.when(dataset == "CommonsenseQA", F.lit("CSQA")).otherwise(dataset)
