"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
NUMERIC_TOKEN = r"(?<![A-Za-z0-9])([0-9]{1,5})(?![A-Za-z0-9])"
SHORT_RUN = r"(?<!\p{Nd})(\p{Nd}{1,5})(?!\p{Nd})"
CLOCK = r"\p{Nd}{1,2}\s*:\s*\p{Nd}{2}"
WIDE_CLOCK = r"\p{Nd}{1,2}\s*[:：]\s*\p{Nd}{2}"
DATE = r"\p{Nd}{1,4}\s*[/\-.]\s*\p{Nd}{1,2}"
CLOCK_OR_HALF_DAY = r"(?i)\b\p{Nd}{1,2}\s*:\s*\p{Nd}{2}\b|(?:am|pm)"
DISTRACTOR = (
    r"(?i)\b(news|sports?|season|episode|crime|india|bangla|telugu|tamil|sony|star|zee|cnn|cnbc|tv)\b"
)
CHANNEL_PREFIX = r"(?i)\b(ch|channel)\b"
RECHECK_SOURCES = (
    "easyocr_numeric_recheck",
    "paddleocr_numeric_recheck",
    "paddleocr_channel_recheck",
    "paddleocr_crop_variant_recheck",
    "paddleocr_slot_proposal_recheck",
    "slot_proposal_recheck",
    "history_guided_slot_recheck",
    "history_roi_prior_recheck",
    "legacy_slot_repair",
    "slot_proposal_v2_cc_textline",
    "temporal_slot_recheck",
)
DERIVED_SOURCES = (
    "easyocr_numeric_recheck",
    "paddleocr_numeric_recheck",
    "paddleocr_channel_recheck",
    "paddleocr_crop_variant_recheck",
    "paddleocr_slot_proposal_recheck",
    "legacy_slot_repair",
    "slot_proposal_v2_cc_textline",
    "refined_numeric_substring",
    "digit_sequence_trim",
    "temporal_slot_recheck",
)
SOURCE_DETAILS = (
    "original_ocr",
    "refined_numeric_substring",
    "paddleocr_channel_recheck",
    "digit_sequence_trim",
    "crop_variant_numeric_recheck",
    "slot_proposal_recheck",
    "legacy_slot_repair",
    "slot_proposal_v2_cc_textline",
    "yolo_channel_number",
    "yolo_channel_number_area",
    "unknown",
)
RAW_SOURCES = (
    "ocr",
    "refined_numeric_substring",
    "paddleocr_channel_recheck",
    "temporal_slot_recheck",
    "easyocr_numeric_recheck",
    "paddleocr_numeric_recheck",
    "digit_sequence_trim",
    "paddleocr_crop_variant_recheck",
    "paddleocr_slot_proposal_recheck",
    "crop_variant_numeric_recheck",
    "slot_proposal_recheck",
    "legacy_slot_repair",
    "slot_proposal_v2_cc_textline",
)
BROAD_REGIONS = (
    "yolo_channel",
    "yolo_channel_area",
    "ocr_neighbor",
    "fallback",
    "fallback_lower_left_mid",
    "full_image",
    "unknown",
)
PROVIDER_PREFIXES = (
    "Virtual_1", "Virtual_2", "Virtual_3", "Virtual_4", "Virtual_5",
    "DirecTV", "Spectrum", "Xfinity", "LG_U+", "Dlive", "SKT", "KT", "An",
)
PRE_SCORE_FIELDS = (
    "ranker_score", "fusion_score", "selector_score", "final_score", "score",
    "rule_score", "ocr_conf", "confidence", "recognizer_conf", "proposal_score",
)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bind(value: Column, use) -> Column:
    """Compute a costly expression once and use it several times in the same row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def digits(text: Column) -> Column:
    return F.regexp_replace(_blank(text), "[^0-9]", "")


def digits_any(text: Column) -> Column:
    """Every Unicode decimal digit is kept."""
    return F.regexp_replace(_blank(text), r"[^\p{Nd}]", "")


def strip_zeros(value: Column) -> Column:
    """Leading zeros go, the last digit stays: `000` becomes `0`."""
    return F.regexp_replace(value, r"^0+(?=\p{Nd})", "")


def numeric_equiv(text: Column) -> Column:
    return strip_zeros(digits(text))


def canonical(value: Column) -> Column:
    """Strip leading zeros of an all-digit value; leave anything else as it is."""
    return F.when(value.rlike(r"^\p{Nd}+$"), strip_zeros(value)).otherwise(value)


def has_alpha(text: Column) -> Column:
    return _blank(text).rlike(r"\p{L}")


def is_alpha_only(text: Column) -> Column:
    return has_alpha(text) & (digits(text) == "")


def is_plain_numeric(text: Column) -> Column:
    return _blank(text).rlike(r"^\s*[0-9]{1,5}\s*$")


def has_numeric_token(text: Column, value: Column) -> Column:
    return F.array_contains(F.regexp_extract_all(_blank(text), F.lit(NUMERIC_TOKEN), 1), value)


def noise_context(source: Column, text: Column, parent_text: Column) -> Column:
    """A refined 3-5 digit token at an edge of a parent with one to four noise characters."""
    value = digits(text)
    parent = strip(_blank(parent_text))
    compact = F.regexp_replace(parent, r"\s+", "")
    noise = F.length(F.regexp_replace(parent, r"[0-9\s:.\-/]", ""))
    return (
        (_blank(source) == "refined_numeric_substring")
        & is_plain_numeric(text)
        & F.length(value).between(3, 5)
        & (parent != "")
        & (digits(parent) == value)
        & (F.startswith(compact, value) | F.endswith(compact, value))
        & noise.between(1, 4)
    )


def trusted_numeric(source: Column, text: Column, parent_text: Column) -> Column:
    value = digits(text)
    return F.length(value).between(2, 5) & (is_plain_numeric(text) | noise_context(source, text, parent_text))


def mixed_alpha(text: Column) -> Column:
    """Letters around digits that do not stand alone."""
    return has_alpha(text) & ~is_plain_numeric(text) & ~has_numeric_token(text, digits(text))


def is_recheck_source(source: Column) -> Column:
    return _blank(source).isin(*RECHECK_SOURCES)


def is_original(source: Column) -> Column:
    return ~_blank(source).isin(*DERIVED_SOURCES)


def text_features(text: Column, stripped: bool = False) -> dict[str, Column]:
    t = text if stripped else strip(_blank(text))
    length = F.length(t)
    at_least_one = F.greatest(F.lit(1), length)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    numbers = F.length(digits_any(t))
    flag = lambda c: c.cast("double")
    return {
        "text_len": flag(length),
        "digit_count": flag(numbers),
        "alpha_count": flag(letters),
        "digit_ratio": numbers / at_least_one,
        "alpha_ratio": letters / at_least_one,
        "candidate_digit_len": flag(F.length(digits(text))),
        "is_plain_numeric": flag(is_plain_numeric(t)),
        "has_alpha": flag(has_alpha(t)),
        "has_colon": flag(F.contains(t, F.lit(":"))),
        "has_pm_am": flag(t.rlike(r"(?i)\b[ap]m\b")),
        "has_sign_or_slash": flag(t.rlike(r"[\-/.,\[\]()]")),
        "starts_with_digit": flag(t.rlike(r"^\p{Nd}")),
        "ends_with_digit": flag(t.rlike(r"\p{Nd}$")),
    }


def _compact(value: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(_blank(value))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def source_alias(source: Column) -> Column:
    """One of `SOURCE_DETAILS` by ordered keyword rules."""
    return bind(_compact(source), _alias_of)


def _alias_of(s: Column) -> Column:
    has = lambda word: F.contains(s, F.lit(word))
    return (
        F.when(s == "", "unknown")
        .when(has("slot_proposal_v2") | has("v2_cc_textline"), "slot_proposal_v2_cc_textline")
        .when(has("legacy_slot_repair") | (has("slot") & has("repair")), "legacy_slot_repair")
        .when(has("history_roi_prior") | (has("slot") & (has("history_guided") | has("proposal"))),
              "slot_proposal_recheck")
        .when(has("crop") & has("variant"), "crop_variant_numeric_recheck")
        .when(has("paddleocr") & has("channel"), "paddleocr_channel_recheck")
        .when(has("refined") & has("numeric"), "refined_numeric_substring")
        .when(has("digit_sequence_trim"), "digit_sequence_trim")
        .when(s.isin("ocr", "original_ocr", "easyocr", "paddleocr"), "original_ocr")
        .when(has("yolo_channel_number_area"), "yolo_channel_number_area")
        .when(has("yolo_channel_number"), "yolo_channel_number")
        .otherwise("unknown")
    )


def broad_region(region: Column) -> Column:
    """One of `BROAD_REGIONS` by ordered keyword rules."""
    return bind(_compact(region), _region_of)


def _region_of(s: Column) -> Column:
    has = lambda word: F.contains(s, F.lit(word))
    return (
        F.when(s == "", "unknown")
        .when(has("fallback_lower_left_mid"), "fallback_lower_left_mid")
        .when(has("fallback"), "fallback")
        .when(has("channel_number_area") | has("yolo_area"), "yolo_channel_area")
        .when(has("yolo") & has("channel"), "yolo_channel")
        .when(has("ocr"), "ocr_neighbor")
        .when(has("full"), "full_image")
        .otherwise("unknown")
    )


def flags(prefix: str, value: Column, options: tuple[str, ...]) -> dict[str, Column]:
    return {f"{prefix}_{o}": (value == o).cast("double") for o in options}


def raw_source_flags(source: Column) -> dict[str, Column]:
    name = F.when(F.trim(_blank(source)) == "", "ocr").otherwise(F.trim(_blank(source)))
    out = flags("source", name, RAW_SOURCES)
    out["source_slot_proposal_recheck"] = name.isin(
        "slot_proposal_recheck", "paddleocr_slot_proposal_recheck").cast("double")
    return out


def group_source(source: Column) -> Column:
    """Source name used when readings are grouped by value."""
    s = F.when(_blank(source) == "", "unknown").otherwise(source)
    return (
        F.when(s.isin("paddleocr_slot_proposal_recheck", "slot_proposal_numeric_recheck"), "slot_proposal_recheck")
        .when(s.isin("paddleocr_crop_variant_recheck", "crop_variant_recheck"), "crop_variant_numeric_recheck")
        .otherwise(s)
    )


def provider_of(image_id: Column, known: tuple[str, ...] = PROVIDER_PREFIXES) -> Column:
    rule = F.when(F.lit(False), F.lit(""))
    for name in known:
        rule = rule.when(F.startswith(image_id, F.lit(name + "_")), name)
    return (
        rule.when(F.startswith(F.lower(image_id), F.lit("dishtv")), "DishTV_no_ui")
        .when(F.contains(image_id, F.lit("_")), F.substring_index(image_id, "_", 1))
        .otherwise("unknown")
    )


def short_runs(text: Column) -> Column:
    """Digit runs of one to five characters; longer runs are not cut."""
    return F.regexp_extract_all(_blank(text), F.lit(SHORT_RUN), 1)


def best_digit(text: Column) -> Column:
    """The longest short run, the first one on ties."""
    # Lengths as a leading number, positions as the second: the greatest pair is the longest run, the first on ties.
    marked = F.transform(short_runs(text), lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("o"), r.alias("run")))
    return F.coalesce(F.array_max(marked)["run"], F.lit(""))


def best_digit_forced(text: Column) -> Column:
    """`best_digit`, or the first five digits when no short run stands alone."""
    best = best_digit(text)
    return F.when(best != "", best).otherwise(F.substring(digits_any(text), 1, 5))


def first_run(text: Column) -> Column:
    return F.coalesce(F.get(short_runs(text), F.lit(0)), F.lit(""))


def classify(text: Column) -> Column:
    t = _blank(text)
    d = digits_any(t)
    solid = F.regexp_replace(t, r"\s", "")
    rest = strip(F.regexp_replace(t, r"\p{Nd}", ""))
    short_label = rest.rlike(r"^[\x00-\x7F]*$") & F.regexp_replace(rest, "[.#]", "").rlike("^[A-Za-z]+$") & (
        F.length(rest) <= 8)
    return (
        F.when(t.rlike(CLOCK), "time")
        .when(t.rlike(DATE), "date")
        .when(d == "", "text")
        .when((F.length(d) == F.length(solid)) & (F.length(d) <= 5), "channelnum")
        .when((F.size(short_runs(t)) == 1) & ((rest == "") | short_label), "channelnum")
        .otherwise("othernum")
    )


def channel_value(text: Column) -> Column:
    """Canonical value of a channel-like text; null for every other kind of text."""
    value = canonical(best_digit(text))
    return F.when((classify(text) == "channelnum") & (value != ""), value)


def name_leading_digits(stem: Column) -> Column:
    return F.regexp_extract(stem, r"^\s*(\p{Nd}+)", 1)


def name_ch_prefix(stem: Column) -> Column:
    """`Ch012_…` names 12; otherwise the leading digits, without zeros."""
    tagged = F.regexp_extract(stem, r"^\s*[Cc][Hh](\p{Nd}+)", 1)
    return strip_zeros(F.when(tagged != "", tagged).otherwise(name_leading_digits(stem)))


def name_channel_tag(stem: Column) -> Column:
    return F.regexp_extract(stem, r"(?i)channel[_-]?(\p{Nd}+)", 1)


def name_all_digits(stem: Column) -> Column:
    return strip_zeros(digits_any(stem))


def is_time_or_date(text: Column) -> Column:
    return _blank(text).rlike(WIDE_CLOCK) | _blank(text).rlike(DATE)


def digit_tokens(text: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(_blank(text).rlike(CLOCK), empty).otherwise(short_runs(text))


def is_numeric_like(text: Column) -> Column:
    return F.length(digits(text)).between(1, 4) & ~_blank(text).rlike(CLOCK_OR_HALF_DAY)


def safe_float(value: Column) -> Column:
    number = value.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(number.isNotNull() & finite, number).otherwise(0.0)


def pre_score(columns: list[str]) -> Column:
    """First present of the score fields, in their fixed order."""
    present = [safe_float(F.col(c)) for c in PRE_SCORE_FIELDS if c in columns]
    guarded = [F.when(F.col(c).isNotNull(), v) for c, v in
               zip([c for c in PRE_SCORE_FIELDS if c in columns], present)]
    return F.coalesce(*guarded, F.lit(0.0)) if guarded else F.lit(0.0)


def misread_bucket(truth: Column, pred: Column) -> Column:
    different = F.aggregate(
        F.zip_with(F.split(truth, ""), F.split(pred, ""), lambda a, b: (a != b).cast("int")),
        F.lit(0), lambda acc, x: acc + x)
    return (
        F.when(_blank(pred) == "", "unread")
        .when(pred == truth, "correct")
        .when(F.length(pred) < F.length(truth), "len_short")
        .when(F.length(pred) > F.length(truth), "len_long")
        .when(different == 1, "sub1")
        .otherwise("subN")
    )


def hash_bucket(key: Column) -> Column:
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % 100).cast("int")


def hash_partition(key: Column, percent: int, below: str = "no_ui_gate_train", above: str = "no_ui_val") -> Column:
    return F.when(hash_bucket(key) < percent, below).otherwise(above)


def text_quality(source: Column, text: Column, parent_text: Column) -> Column:
    parent = _blank(parent_text)
    refined = _blank(source) == "refined_numeric_substring"
    context = F.when(refined & (parent != ""), parent).otherwise(_blank(text))
    lettered = has_alpha(text) | (refined & has_alpha(parent))
    plain = F.when(is_plain_numeric(text), 0.12).otherwise(0.0)
    distractor = F.when(context.rlike(DISTRACTOR), -0.55).otherwise(0.0)
    crowded = F.lit(-0.65) + (
        F.when(~has_numeric_token(context, digits(text)), -0.25).when(refined, -0.10).otherwise(0.0))
    alpha = F.when(~lettered, 0.0).when(noise_context(source, text, parent_text), -0.20).otherwise(crowded)
    return plain + distractor + alpha


def capture_key(name: Column) -> Column:
    """Truth, slot and position of one delayed capture of a screen."""
    part = lambda pattern: F.regexp_extract(name, pattern, 1)
    or_unknown = lambda c, d: F.when(c == "", d).otherwise(c)
    return F.struct(
        or_unknown(part(r"^(Ch\p{Nd}+)"), "Ch?").alias("truth"),
        or_unknown(part(r"captured_(Ch\p{Nd}+)_"), "?").alias("slot"),
        or_unknown(part(r"(findPosition\p{Nd}+)"), "?").alias("position"),
    )


def ema_settings(frames: int) -> dict[str, float]:
    """Smoothing span of N frames: alpha, warm-up and minimum sightings."""
    return {"alpha": round(2.0 / (frames + 1), 4), "warmup": frames, "min_seen": max(2, min(3, frames))}


def policy_text(value: Column, held_out: str) -> Column:
    """Lower-cased text without the markers that announce the held-out name's absence."""
    out = F.lower(_blank(value))
    for marker in (f"no_{held_out}", f"no-{held_out}", f"non_{held_out}", f"non-{held_out}"):
        out = F.replace(out, F.lit(marker), F.lit(""))
    return out


def mentions(value: Column, held_out: str) -> Column:
    return F.contains(policy_text(value, held_out), F.lit(held_out))


def elongated_penalty(source: Column, text: Column, width: Column, height: Column) -> Column:
    count = F.length(digits(text))
    ratio = F.greatest(F.lit(1.0), width) / F.greatest(F.lit(1), count) / F.greatest(F.lit(1.0), height)
    return F.when((_blank(source) == "") & is_plain_numeric(text) & count.between(1, 5) & (ratio > 1.5), 1.0).otherwise(0.0)


def sureness(conf: Column | str) -> Column:
    """A reading's confidence; one that is missing or 0 counts as 0.5."""
    value = F.col(conf) if isinstance(conf, str) else conf
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(0.5))
