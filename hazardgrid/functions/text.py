"""Text normalisation as Column expressions (no UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions.binding import let

# ASCII whitespace plus the Latin-1 separators that also count as blank.
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def literal_map(mapping: dict) -> Column:
    """A constant map column; only for vocabularies of fixed size."""
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])


def lookup(mapping: dict, key: Column) -> Column:
    """``mapping[key]`` or NULL, also under ANSI mode and for NULL keys."""
    return F.try_element_at(literal_map(mapping), F.coalesce(key, F.lit("")))


def strip(col) -> Column:
    return F.btrim(col, F.lit(_BLANKS))


def blank_to_null(col) -> Column:
    return F.nullif(strip(col), F.lit(""))


def clip(col, limit: int) -> Column:
    """Strip, cut to ``limit`` characters, blank becomes NULL."""
    return F.nullif(F.substring(strip(col), 1, limit), F.lit(""))


def letters_only(col) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), "[^A-Z]", "")


def normalize_county(col) -> Column:
    """Canonical county name, NULL when the spelling is not a known county."""
    return lookup({c.upper().replace(" ", ""): c for c in V.COUNTIES}, letters_only(col))


def county_code(col) -> Column:
    """Two-digit ordinal of a canonical county name."""
    return lookup({c: f"{i:02d}" for i, c in enumerate(V.COUNTIES, 1)}, col)


def normalize_municipality(col) -> Column:
    """Upper-case words with the type suffix spelled out and known aliases applied."""
    words = F.trim(F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), "[^A-Z0-9]+", " "))
    for short, full in V.MUNICIPALITY_SUFFIXES.items():
        words = F.regexp_replace(words, f"(^| ){short}$", f"$1{full}")
    return let(words, lambda w: F.coalesce(lookup(V.MUNICIPALITY_ALIASES, w), w))


def build_external_id(county, year, source_id) -> Column:
    """``NJDOT:year:COUNTY:id``, hashed when longer than the key column allows."""
    token = F.regexp_replace(F.upper(county), " ", "_")
    year = year.cast("string")
    raw = F.concat_ws(":", F.lit(V.SOURCE_PREFIX), year, token, strip(source_id))
    complete = county.isNotNull() & year.isNotNull() & source_id.isNotNull()
    return F.when(complete, let(raw, lambda r: F.when(F.length(r) <= V.EXTERNAL_ID_MAX, r).otherwise(
        F.concat_ws(":", F.lit(V.SOURCE_PREFIX), year, F.substring(token, 1, 8), F.substring(F.sha2(r, 256), 1, 20)))))


def map_severity_fip(col) -> Column:
    return lookup(V.ARCHIVE_SEVERITY, F.upper(strip(col)))


def kabco_code(col) -> Column:
    """Trailing ``(K)``-style letter, or the bare letter itself."""
    return let(strip(F.coalesce(col, F.lit(""))), lambda text: F.coalesce(
        F.nullif(F.regexp_extract(text, r"\(([KABCO])\)$", 1), F.lit("")), F.when(text.isin(*V.KABCO_SEVERITY), text)))


# A JSON array of strings without escapes or control characters.
_PLAIN_LABELS = r'^\[ *("[^"\\\x00-\x1f]*" *(, *"[^"\\\x00-\x1f]*" *)*)?\]$'


def summary_labels(col) -> Column:
    """Label array of a summary cell: JSON array, single label, or empty.

    NULL marks an invalid cell (broken JSON or a member that is not a string).
    """
    def labels(text):
        kind = F.schema_of_variant(F.try_parse_json(text))
        # Most cells need no look at their types, which costs a second parse.
        strings = F.when(text.rlike(_PLAIN_LABELS) | kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.from_json(text, "array<string>"))
        return (
            F.when(text == "", F.array().cast("array<string>"))
            .when(~text.startswith("["), F.array(text))
            .otherwise(let(strings, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), p)))
        )
    return let(strip(F.coalesce(col, F.lit(""))), labels)


def severity_weight(col) -> Column:
    """Weight of a severity label, 1 for any other label."""
    return F.coalesce(lookup(V.SEVERITY_WEIGHTS, col), F.lit(V.OTHER_WEIGHT))


def network_weight(col) -> Column:
    """As :func:`severity_weight`, with an unknown injury counted as an injury."""
    weights = {**V.SEVERITY_WEIGHTS, "injury_unknown": V.UNKNOWN_INJURY_WEIGHT}
    return F.coalesce(lookup(weights, col), F.lit(V.OTHER_WEIGHT))


def severity_category(col) -> Column:
    return F.when(col.isin(*V.SEVERITIES), col).otherwise("other")


def rate_band(col) -> Column:
    return F.when(col > 10, "high").when(col > 5, "medium").otherwise("low")


def road_key(sri, name, segment_id) -> Column:
    """Identity of a road for corridor grouping: route id, else name, else itself."""
    route = F.nullif(F.upper(F.trim(sri)), F.lit(""))
    named = F.nullif(F.regexp_replace(F.upper(F.trim(name)), r"\s+", " "), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("sri:"), route),
        F.concat(F.lit("name:"), named),
        F.concat(F.lit("segment:"), segment_id.cast("string")),
    )


def title_words(col) -> Column:
    """Capital after every non-alphanumeric character, lower case elsewhere."""
    pieces = F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(
        F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)),
    )), "")


def display_road_name(name, sri) -> Column:
    return title_words(F.coalesce(
        F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(sri), F.lit("")), F.lit("Unnamed"),
    ))


def functional_road_class(code) -> Column:
    """``struct(road_class, road_type)`` of a numeric functional class code."""
    from hazardgrid.functions.numbers import parse_float

    def classify(whole):
        road_class = (
            F.when(whole.between(1, 4), "arterial").when(whole.between(5, 6), "collector")
            .when(whole == 7, "local").otherwise("unclassified")
        )
        label = F.concat(F.lit("functional_class_"), F.coalesce(whole.cast("string"), F.lit("unknown")))
        return F.struct(road_class.alias("road_class"), label.alias("road_type"))

    number = let(parse_float(code.cast("string")), lambda v: F.when(
        (v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long")))
    return let(number, classify)


def osm_road_class(col) -> Column:
    return F.coalesce(lookup(V.OSM_ROAD_CLASS, col), F.lit("local"))


def csv_formula_guard(col) -> Column:
    """Quote text a spreadsheet would run as a formula."""
    return F.when(strip(col).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)


def fill_unknown_label(col) -> Column:
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit("unknown"))
