"""Column expressions: all of them run inside whole-stage code generation, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

# White space, Unicode's and the ASCII separators.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)$"
_FLOAT = r"(?i)^[-+]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[-+]?\d+(_\d+)*)?|inf|infinity|nan)$"


def col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


# --- text


def strip(c) -> Column:
    """Without white space at both ends; Unicode's too, which trim() leaves."""
    return F.btrim(col(c), F.lit(BLANKS))


def na_to_null(c) -> Column:
    """Null for the tokens that a CSV reader takes for null."""
    c = col(c)
    return F.when(~c.isin(*vocab.NA_TOKENS), c)


def is_disguised(c) -> Column:
    """Whether text stands for a missing value; null for null."""
    return F.lower(strip(c)).isin(*vocab.DISGUISED_NULLS)


def is_missing(c) -> Column:
    return F.coalesce(is_disguised(c), F.lit(True))


def is_blank(c) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def has_outer_space(c) -> Column:
    return F.coalesce(col(c) != strip(c), F.lit(False))


def display(c) -> Column:
    """Text in quotes, with line ends and tabs spelled out."""
    out = F.replace(col(c), F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    quote = F.when(out.contains("'") & ~out.contains('"'), F.lit('"')).otherwise(F.lit("'"))
    out = F.when(out.contains("'") & out.contains('"'), F.replace(out, F.lit("'"), F.lit("\\'"))).otherwise(out)
    return F.concat(quote, out, quote)


def first_values(columns: list[str], n: int = 4) -> Column:
    """The first values of a row on one line; null shows as nan."""
    return F.concat_ws(" | ", *(F.coalesce(col(c).cast("string"), F.lit("nan")) for c in columns[:n]))


# --- numbers


def num(c) -> Column:
    """The number that a whole text is, else null: exponents and infinities count; separators, signs of currency, hex and nan don't."""
    plain = F.btrim(col(c), F.lit(" \t\r\n"))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def num_detected(c) -> Column:
    """num() without thousands separators, dollars and percents."""
    return num(F.translate(col(c), ",$%", ""))


def num_fixed(c) -> Column:
    """num() without thousands separators and dollars."""
    return num(strip(F.translate(col(c), ",$", "")))


def is_numeric_detected(c) -> Column:
    """Numeric as the mixed-type rule sees it: also with , $ % and with digits grouped by underscores; nan counts."""
    return strip(F.translate(col(c), ",$%", "")).rlike(_FLOAT)


def is_numeric_fixed(c) -> Column:
    """Numeric as the repair sees it: percents don't count, null does."""
    return F.coalesce(strip(F.translate(col(c), ",$", "")).rlike(_FLOAT), F.lit(True))


def num_prefix(c) -> Column:
    """The number that a text begins with, as C's strtod reads it (decimal forms only)."""
    return F.regexp_extract(col(c), r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)", 1).try_cast("double")


def has_middle_dash(c) -> Column:
    """A '-' or '/' other than first or last: a phone number or a date, not a number."""
    return F.coalesce(col(c).rlike(r"(?s)^.+[-/].+$"), F.lit(False))


def num_role(c) -> Column:
    """The number that counts when columns are judged numeric for models."""
    return F.when(~has_middle_dash(strip(c)), num(c))


def number_text(x: Column, places: int = 2) -> Column:
    """Whole numbers without a point, others rounded and without trailing zeros."""
    text = F.round(x, places).cast(f"decimal(38,{places})").cast("string")
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(text, r"0+$", ""))


def whole_text(c) -> Column:
    """34.0 -> 34 for text that is numeric and not missing; other text stays."""
    c = col(c)
    x = num(c)
    return F.when(x.isNotNull() & (F.abs(x) < 1e18) & ~is_missing(c), x.cast("decimal(38,0)").cast("string")).otherwise(c)


# --- dates


def date_signature(c) -> Column:
    """Which way of writing a date a text has."""
    v = strip(c)
    parts = F.split(v, "/")
    slashes = (
        F.when((F.size(parts) == 3) & (F.length(F.get(parts, F.lit(2))) == 4), "MM/DD/YYYY")
        .when((F.size(parts) == 3) & (F.length(F.get(parts, F.lit(0))) == 4), "YYYY/MM/DD")
        .otherwise("OTHER")
    )
    return F.when(col(c).isNull(), None).when(F.instr(v, "-") == 5, "YYYY-MM-DD").when(v.contains("/"), slashes).when(v.contains(" "), "MONTH DD YYYY").otherwise("OTHER")


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def parse_date(c, swap_iso: bool = False) -> Column:
    """The date that a text is, else null. a/b/yyyy is day first unless b can't be a month; yyyy-a-b is month first,
    or with swap_iso day first unless b can't be a month; months may be names. A time of day may follow."""
    whole = strip(c)
    clock = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(?i:am|pm|z)?$"
    v = F.when(whole.contains(":"), F.regexp_replace(whole, clock, "")).otherwise(whole)
    part = lambda pattern, k: F.regexp_extract(v, pattern, k)
    iso = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
    year, a, b = part(iso, 1), part(iso, 2), part(iso, 3)
    by_iso = F.when(F.lit(swap_iso) & (b.try_cast("int") <= 12), _made(year, b, a)).otherwise(_made(year, a, b))
    end = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    d, m, y = part(end, 1), part(end, 2), part(end, 3)
    by_end = F.when(m.try_cast("int") <= 12, _made(y, m, d)).otherwise(_made(y, d, m))
    named = r"(?i)^([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$"
    named2 = r"(?i)^(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?,?\s+(\d{4})$"
    number = lambda at: F.when((at > 0) & (at % 4 == 1), ((at + 3) / 4).cast("int").cast("string"))
    by_name = _made(part(named, 3), number(_locate(part(named, 1))), part(named, 2))
    by_name2 = _made(part(named2, 3), number(_locate(part(named2, 2))), part(named2, 1))
    some = F.length(whole).between(8, 40) & whole.rlike(r"\d{4}")  # most text fails here
    plain = F.lit(not swap_iso) & (F.length(v) == 10) & v.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(~some, None).when(plain, v.try_cast("date")).when(v.rlike(iso), by_iso).when(v.rlike(end), by_end).when(v.rlike(named), by_name).when(v.rlike(named2), by_name2)


def _locate(name: Column) -> Column:
    """Where a month's first three letters stand in the list of months."""
    return F.instr(F.lit(vocab.MONTHS), F.lower(F.substring(name, 1, 3)))


def is_date(c) -> Column:
    return parse_date(c).isNotNull()


def normalize_date(c, swap_iso: bool = False) -> Column:
    """ISO text of a date; texts with 9999 or 99-99, of years outside 1900-2100 or that aren't dates stay as they are."""
    c = col(c)
    d = parse_date(c, swap_iso)
    keep = c.contains("9999") | c.contains("99-99") | d.isNull() | ~F.year(d).between(1900, 2100)
    return F.when(keep, c).otherwise(F.date_format(d, "yyyy-MM-dd"))


# --- similarity


def fuzzy_norm(c) -> Column:
    """ASCII letters, digits and single blanks, lower case; a blank may stay at the end, none at the start."""
    plain = F.regexp_replace(col(c), "[^A-Za-z0-9 ]", " ")
    return F.ltrim(F.regexp_replace(F.lower(plain), " +", " "))


def fuzzy_tokens(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda x: x != ""))


def edit_similarity(a: Column, b: Column, raw_a: Column, raw_b: Column) -> Column:
    """1 - edit distance of normalised texts over the longer raw text's bytes."""
    longest = F.greatest(F.octet_length(raw_a), F.octet_length(raw_b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fuzzy_similarity(a, b) -> Column:
    """0.4 * edit similarity + 0.6 * token overlap of two texts."""
    a, b = col(a), col(b)
    x, y = fuzzy_norm(a), fuzzy_norm(b)
    return 0.4 * edit_similarity(x, y, a, b) + 0.6 * jaccard(fuzzy_tokens(x), fuzzy_tokens(y))


# --- models


def min_max(x: Column, low: Column, high: Column) -> Column:
    """0 to 1; 0.5 where the range is nil."""
    return F.when(high - low < 1e-8, F.lit(0.5)).otherwise((x - low) / (high - low))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.when(std < 1e-8, F.lit(1.0)).otherwise(std)


def from_z(z: Column, mean: Column, std: Column) -> Column:
    return z * F.when(std < 1e-8, F.lit(1.0)).otherwise(std) + mean


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def relu_slope(x: Column) -> Column:
    return F.when(x > 0, 1.0).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_slope(x: Column) -> Column:
    s = sigmoid(x)
    return s * (1 - s)


def mse(xs: list[Column], ys: list[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(xs, ys):
        total = total + (x - y) * (x - y)
    return total / len(xs)


def mse_slope(x: Column, y: Column, n: int) -> Column:
    return 2 / n * (x - y)
