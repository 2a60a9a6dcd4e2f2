"""Rules that read meaning out of names: lots, wafers, parts, dates, test ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Part numbers that stand for one and the same product.
PART_ALIASES = {
    "8VLG910NQ20XV-L0OMZ": "8VLG910NQ20XV",
    "8VL8744NQ20XV-L0VGZ": "8VLG910NQ20XV",
    "8TLG912NQ20V-L0DZ": "8VLG910NQ20XV",
}
NO_PART = ("NO_RECORD", "TIMEOUT", "UNKNOWN")

# Readable endings of feature names.
STAT_LABELS = {
    "mean": " mean",
    "std": " standard deviation",
    "median": " (Median)",
    "iqr": " (IQR)",
    "outlier_rate": " (Outlier%)",
    "missing_rate": " (Missing%)",
    "min": " (Min)",
    "max": " (Max)",
    "p01": " (1st Percentile)",
    "p05": " (5th Percentile)",
    "p25": " (25th Percentile)",
    "p50": " (50th Percentile)",
    "p75": " (75th Percentile)",
    "p95": " (95th Percentile)",
    "p99": " (99th Percentile)",
    "ppm_near_LSL_pct": " (PPM near LSL %)",
    "ppm_near_LSL_sigma": " (Sigma to LSL)",
    "ppm_near_USL_pct": " (PPM near USL %)",
    "ppm_near_USL_sigma": " (Sigma to USL)",
    "psi__is_major": " (PSI Major Shift)",
    "psi__is_minor": " (PSI Minor Shift)",
    "psi__score": " (PSI Score)",
    "spc__is_shift": " (SPC Shift)",
    "spc__median_shift": " (SPC Median Shift)",
    "spc__sigma_dist": " (SPC Sigma Distance)",
}


def _match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of the pattern, NULL when there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def timestamp_index(text: Column) -> Column:
    """Trailing digits of ``timestamp_12`` as a number."""
    return F.regexp_extract(text, r"(\d+)$", 1).try_cast("int")


def normalise_lot(lot: Column) -> Column:
    return F.lower(F.trim(lot.cast("string")))


def normalise_wafer(wafer: Column) -> Column:
    """Whole numbers lose their decimals and leading zeros; other ids are only trimmed."""
    text = F.trim(wafer.cast("string"))
    number = text.try_cast("double")
    whole = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & (
        F.abs(number - F.round(number)) <= 1e-8 + 1e-5 * F.abs(F.round(number))
    )
    return F.when(whole, F.rint(number).try_cast("long").cast("string")).otherwise(text)


def normalize_colname(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9_]+", "_")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def sanitize_name(name: Column) -> Column:
    """Cleaned feature identifier before duplicates are numbered."""
    text = F.translate(name, "[]<>", "()__")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", "_"), r"[^0-9a-zA-Z_().:+-]", "_")


def yield_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")


def lot_from_path(folder: Column, file_name: Column | None = None) -> Column:
    """A SYN lot of the file name first, else the leading token(s) of the folder."""
    parts = F.split(folder, "_")
    two = (parts[0] == "SYN") & (F.size(parts) >= 2)
    from_folder = F.when(two, F.concat(parts[0], F.lit("_"), F.get(parts, F.lit(1)))).otherwise(parts[0])
    if file_name is None:
        return from_folder
    return F.coalesce(_match(file_name, r"(SYN_\d+)", 1), from_folder)


def normalize_lot_id(lot: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(lot, F.lit("")), r"\.[a-zA-Z0-9]+$", ""))


def normalize_partname(part: Column) -> Column:
    """First listed part, upper-case, without blanks, aliases, C/H prefix letter and -D/-L ending."""
    raw = F.trim(F.coalesce(part, F.lit("")))
    tokens = F.filter(F.transform(F.split(raw, r"[\n,]+"), lambda t: F.trim(t)), lambda t: t != "")
    token = F.regexp_replace(F.upper(F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))), r"\s+", "")
    aliases = F.create_map(*[F.lit(item) for pair in PART_ALIASES.items() for item in pair])
    short = F.regexp_replace(token, r"^(\d+)[CH]L", "$1L")
    cut = F.regexp_replace(short, r"(?i)[-_](D|L)$", "")
    named = F.coalesce(F.try_element_at(aliases, token), cut)
    return F.when(raw.isin("", *NO_PART), F.lit("")).otherwise(named)


def product_key(generic: Column, part: Column) -> Column:
    name, suffix = F.trim(F.coalesce(generic, F.lit(""))), normalize_partname(part)
    return F.when(suffix == "", name).otherwise(F.concat(name, F.lit("_"), suffix))


# Date blocks in names, a year first, a year last, a year alone.
DATE_YEAR_FIRST = r"(?:\b|_|-)((?:20|19)\d{6})(?:\b|_|-)"
DATE_YEAR_LAST = r"(?:\b|_|-)(\d{4}(?:20|19)\d{2})(?:\b|_|-)"
YEAR_ALONE = r"(?:\b|_|-)(20\d{2})(?:\b|_|-)"


def fiscal_year(text: Column) -> Column:
    """Four-digit year of a date block in a name; the strictest pattern wins."""
    in_range = lambda year: year.try_cast("int").between(2010, 2040)
    tail, head = (lambda m: F.substring(m, 5, 4)), (lambda m: F.substring(m, 1, 4))
    blocks = F.regexp_extract_all(text, F.lit(r"_(\d{8})_"), F.lit(1))
    years = F.transform(blocks, lambda m: F.when(in_range(tail(m)), tail(m)).when(in_range(head(m)), head(m)))
    return F.coalesce(
        F.get(F.filter(years, lambda y: y.isNotNull()), F.lit(0)),
        F.substring(_match(text, DATE_YEAR_FIRST, 1), 1, 4),
        F.substring(_match(text, DATE_YEAR_LAST, 1), 5, 4),
        _match(text, YEAR_ALONE, 1),
        F.lit("Unknown"),
    )


def _two_digits(number: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def wafer_list(name: Column) -> Column:
    """``W1_[03-01]`` lists 03, 02, 01; ``W1_[1,2]`` lists 01, 02; otherwise empty."""
    inner = F.translate(F.regexp_extract(name, r"\[(.*?)\]", 1), ";", ",")
    items = F.transform(F.split(inner, ","), lambda t: F.trim(t))
    span = r"^(\d{1,3})\s*-\s*(\d{1,3})$"

    def expand(item: Column) -> Column:
        low = F.regexp_extract(item, span, 1).try_cast("int")
        high = F.regexp_extract(item, span, 2).try_cast("int")
        return (
            F.when(item.rlike(span), F.transform(F.sequence(low, high), _two_digits))
            .when(item.rlike(r"^\d{1,3}$"), F.array(_two_digits(item.try_cast("int"))))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.flatten(F.transform(items, expand))


def combo_folder_valid(name: Column) -> Column:
    """Whether a folder is named ``LOT_[WW]`` or ``LOT_[WW]_YY%``."""
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    return F.coalesce(name.rlike(rf"^.+_\[[0-9, \-]*\](?:_{number}%)?$"), F.lit(False))


def lot_folder(path: Column) -> Column:
    """Deepest ancestor whose name is a valid lot folder; NULL when there is none."""
    valid = F.filter(F.split(path, "/"), combo_folder_valid)
    return F.get(valid, F.size(valid) - 1)


def shorten_wafer_list(name: Column) -> Column:
    """More than five listed wafers are written as a range."""
    shape = r"^([^\[]*)\[([^\[\]]*)\]([^\]]*)"
    numbers = F.filter(F.split(F.regexp_extract(name, shape, 2), r"[-\s,]+"), lambda t: t.rlike(r"^\d+$"))
    values = F.transform(numbers, lambda t: t.try_cast("int"))
    short = F.concat(
        F.regexp_extract(name, shape, 1), F.lit("["), _two_digits(F.array_min(values)), F.lit("-"),
        _two_digits(F.array_max(values)), F.lit("]"), F.regexp_extract(name, shape, 3),
    )
    return F.when(name.rlike(shape) & (F.size(values) > 5), short).otherwise(name)


def wafer_from_filename(files: DataFrame, file_name: str = "filename", folder: str = "folder", name: str = "wafer_info") -> DataFrame:
    """Adds struct(lot, wafer, prefix, suffix) by ranked token rules; wafer is NULL when no token fits.

    Each stage is its own column, so tokens and expected wafers are worked out once per row.
    """
    head = F.split(F.col(folder), r"_\[")
    before = F.split(head[0], "_")
    lot = F.when(F.size(head) > 1, F.get(before, F.size(before) - 1)).otherwise(
        F.coalesce(_match(F.col(folder), r"(?i)W\d+(?:[.\-]\d+)?"), F.split(F.col(folder), "_")[0])
    )
    staged = files.withColumns(
        {"_lot": lot, "_expected": wafer_list(F.col(folder)), "_tokens": F.split(F.col(file_name), r"[_,\s\-]+")}
    )
    tokens, size = F.col("_tokens"), F.size("_tokens")
    starts = F.transform(tokens, lambda t: F.startswith(F.upper(t), F.upper(F.col("_lot"))))
    staged = staged.withColumn("_at", F.array_position(starts, F.lit(True)).cast("int"))  # 1-based, 0 when absent

    # Tokens that may hold the wafer: up to three after the lot (ranks 1, 3), then the rest of the lot token (2, 4).
    own = F.get(tokens, F.col("_at") - 1)
    rest = F.regexp_replace(F.regexp_replace(F.substr(own, F.length("_lot") + 1), r"^[_\-]+", ""), r"^\.+", "")
    place = lambda text, at, bump: F.struct(text.alias("text"), at.alias("at"), F.lit(bump).alias("bump"))
    later = [
        F.when((F.col("_at") > 0) & (F.col("_at") + k <= size), place(F.get(tokens, F.col("_at") + k - 1), F.col("_at") + k, 0))
        for k in (1, 2, 3)
    ]
    inside = F.when((F.col("_at") > 0) & (F.length(own) > F.length("_lot")), place(rest, F.col("_at"), 1))
    staged = staged.withColumn("_places", F.array_compact(F.array(*later, inside)))

    fits = lambda v: (v <= 25) & ((F.size("_expected") == 0) | F.array_contains("_expected", _two_digits(v)))
    entry = lambda rank, p, v: F.struct(rank.alias("rank"), p["at"].alias("at"), v.alias("wafer"))

    # No number is NULL before the cast: casting empty text raises and catches an error for every token.
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")

    def read(p: Column) -> Column:
        full, part = number(p["text"], r"^[wW]?(\d+)$"), number(p["text"], r"^[wW]?(0*\d{1,2})")
        return F.when(fits(full), entry(p["bump"] + 1, p, full)).when(fits(part), entry(p["bump"] + 3, p, part))

    best = F.array_min(F.array_compact(F.transform("_places", read)))
    staged = staged.withColumn("_best", best)
    tail = F.transform(
        F.slice(tokens, F.col("_best.at") + 1, F.greatest(size, F.lit(1))), lambda t: F.split(t, r"(?i)\.std|\.csv")[0]
    )
    staged = staged.withColumn("_tail", tail)
    stops = F.transform("_tail", lambda t: (t == "") | t.rlike(r"^\d{5,}$") | F.contains(F.lower(t), F.lit("combined")))
    staged = staged.withColumn("_stop", F.array_position(stops, F.lit(True)).cast("int"))
    kept = F.when(F.col("_stop") > 0, F.slice("_tail", F.lit(1), F.col("_stop") - 1)).otherwise(F.col("_tail"))
    prefix = F.when(F.contains(F.col(file_name), F.col("_lot")), F.split_part(F.col(file_name), F.col("_lot"), F.lit(1)))
    info = F.struct(
        F.col("_lot").alias("lot"), F.col("_best.wafer").alias("wafer"), F.coalesce(prefix, F.lit("")).alias("prefix"),
        F.coalesce(F.when(F.size(kept) > 0, F.array_join(kept, "_")), F.lit("WS")).alias("suffix"),
    )
    return staged.select(*files.columns, info.alias(name))


def creation_timestamp(text: Column) -> Column:
    """Either ``MM/dd/yyyy HH:mm:ss`` or ``MMM d yyyy HH:mm:ss``."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("M/d/yyyy H:m:s")), F.try_to_timestamp(text, F.lit("MMM d yyyy H:m:s"))
    )


def experiment_key(name: Column) -> Column:
    """``Day_2024_07_02_Wafer_01`` becomes ``2024-07-02_01``; other names become NULL."""
    shape = r"^Day_(\d{4})_(\d{2})_(\d{2})_Wafer_(\d+)$"
    wafer = _two_digits(F.regexp_extract(name, shape, 4).try_cast("int"))
    key = F.concat(
        F.regexp_extract(name, shape, 1), F.lit("-"), F.regexp_extract(name, shape, 2), F.lit("-"),
        F.regexp_extract(name, shape, 3), F.lit("_"), wafer,
    )
    return F.when(name.rlike(shape), key)


def group_key(folder: Column, path: Column, pattern: str = r"(?i)\b([A-Z]{1,3}\d{4,})") -> Column:
    """Leakage group: the folder, else a wafer id found in the path, else the path itself."""
    named = F.when(~F.lower(F.trim(folder)).isin("", "nan"), F.trim(folder))
    own = F.when(F.trim(path) != "", F.trim(path))
    return F.coalesce(named, F.upper(_match(path, pattern, 1)), own, F.lit("UNKNOWN_GROUP"))


def test_code(number: Column, scale: Column) -> Column:
    """Test number to ``T<major>.<minor>``."""
    major = F.floor(number / scale).cast("long").cast("string")
    return F.concat(F.lit("T"), major, F.lit("."), (number % scale).cast("long").cast("string"))


def test_order(name: Column) -> Column:
    """struct(major, minor) for sorting T-numbers; other names sort last."""
    shape = r"T(\d+)(?:\.(\d+))?"
    major = F.coalesce(_match(name, shape, 1).try_cast("int"), F.lit(999999))
    minor = F.when(name.rlike(shape), F.coalesce(_match(name, shape, 2).try_cast("int"), F.lit(0)))
    return F.struct(major.alias("major"), F.coalesce(minor, F.lit(999999)).alias("minor"))


def natural_sort(name: Column) -> Column:
    """Sort key that compares embedded digit runs by value."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    plain = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    # The number of digits comes first, so runs of any length compare by value.
    valued = lambda r: F.concat(F.lpad(F.length(plain(r)).cast("string"), 10, "0"), plain(r))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), valued(r)).otherwise(r)), "")


def parse_feature_name(name: Column) -> Column:
    """``FT_t1_0__p50`` is struct(test T1.0, stat median)."""
    clean = F.regexp_replace(name, "FT_", "")
    parts = F.split(clean, "__", 2)
    stat = F.coalesce(F.get(parts, F.lit(1)), F.lit("mean"))
    return F.struct(
        F.translate(F.upper(parts[0]), "_", ".").alias("test"),
        F.when(stat == "p50", "median").otherwise(stat).alias("stat"),
    )


def readable_feature_name(name: Column) -> Column:
    """``TP_t1_0__mean`` becomes ``T1.0 mean``."""
    bare = F.regexp_replace(name, "^(TP|FT)_", "")
    dotted = lambda text: F.translate(F.upper(text), "_", ".")
    split_at = F.instr(bare, ": ")

    def styled(base: Column) -> Column:
        lead = F.substr(base, F.lit(1), split_at + 1)
        return F.when(split_at > 0, F.concat(lead, dotted(F.substr(base, split_at + 2)))).otherwise(dotted(base))

    out = F.when(F.coalesce(name, F.lit("")) == "", name)
    out = out.when(name.startswith("WP_"), F.initcap(F.translate(F.regexp_replace(name, "^WP_", ""), "_", " ")))
    out = out.when(bare.startswith("Principal Factor"), bare)
    out = out.when(bare.startswith("Factor"), F.replace(bare, F.lit("Factor"), F.lit("Principal Factor")))
    shape = rf"^(.*)__({'|'.join(STAT_LABELS)})$"
    labels = F.create_map(*[F.lit(x) for pair in STAT_LABELS.items() for x in pair])
    ending = F.regexp_extract(bare, shape, 2)
    base = F.when(ending != "", F.regexp_extract(bare, shape, 1)).otherwise(bare)
    return out.otherwise(F.concat(styled(base), F.coalesce(F.try_element_at(labels, ending), F.lit(""))))


def cert_id(lot: Column, generic: Column, score: Column) -> Column:
    """First sixteen upper-case hex digits of sha256(lot-generic-score)."""
    text = F.concat_ws("-", lot, generic, score.cast("string"))
    return F.upper(F.substring(F.sha2(text, 256), 1, 16))


def tester_family(tester: Column) -> Column:
    """Tester name without its C1..C5 suffix, grouped into known families."""
    name = F.regexp_replace(F.upper(F.trim(tester)), "_C[1-5]$", "")
    has = lambda token: F.contains(name, F.lit(token))
    return (
        F.when(has("J750") | has("TS88") | has("ETS"), "J750")
        .when(has("EAGLE"), "EAGLE")
        .when(has("CATALYST"), "CATALYST")
        .when(has("HP94K"), "HP94K")
        .otherwise(name)
    )
