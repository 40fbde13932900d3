"""Codes, cells, names and sensitive text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fiscal import be_to_date
from .money import _c

# Cell texts that mean "empty".
EMPTY_CELLS = ["", "-", "N/A", "n/a", "nan", "NaN"]

# Patterns that reveal a secret and what replaces them, applied in this order.
SECRET_PATTERNS = [
    (r"password[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "password=***MASKED***"),
    (r"pwd[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "pwd=***MASKED***"),
    (r"passwd[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "passwd=***MASKED***"),
    (r"pass[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "pass=***MASKED***"),
    (r"api[_-]?key[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "api_key=***MASKED***"),
    (r"token[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "token=***MASKED***"),
    (r"access[_-]?token[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "access_token=***MASKED***"),
    (r"refresh[_-]?token[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "refresh_token=***MASKED***"),
    (r"bearer\s+[a-zA-Z0-9\-._~+/]+=*", "bearer ***MASKED***"),
    (r"secret[_-]?key[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "secret_key=***MASKED***"),
    (r"secret[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "secret=***MASKED***"),
    (r"session[_-]?id[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "session_id=***MASKED***"),
    (r"sid[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "sid=***MASKED***"),
    (r"authorization[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "authorization=***MASKED***"),
    (r"auth[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "auth=***MASKED***"),
    (r"postgresql://[^:]+:[^@]+@", "postgresql://***:***@"),
    (r"mysql://[^:]+:[^@]+@", "mysql://***:***@"),
    (r"mongodb://[^:]+:[^@]+@", "mongodb://***:***@"),
    (r"credential[s]?[\"']?\s*[:=]\s*[\"']?[^\s\"']+", "credentials=***MASKED***"),
]

# A parameter whose name contains one of these is hidden.
SECRET_KEYS = [
    "password", "passwd", "pwd", "pass", "secret", "token", "api_key", "apikey",
    "auth", "authorization", "session", "credit_card", "ssn", "social_security",
]

# Layout of claim and statement file names.
CLAIM_FILE = r"^eclaim_(\d+)_([A-Z_]+)_(\d{8})_(\d+)\.xls"
STATEMENT_FILE = r"(?i)^STM_(\d+)_(IP|OP)(UCS|OFC|SSS|LGO)(\d{4})(\d{2})_(\d+)\.xls"

# Pieces of a drug's full name.
DRUG_PATTERNS = {
    "generic_name": (r"\(([a-zA-Z][a-zA-Z\s\-\+]+?)\s+([\d\.]+\s*\w+(?:/[\d\.]+\s*\w+)?)\)", 1),
    "strength": (r"\(([a-zA-Z][a-zA-Z\s\-\+]+?)\s+([\d\.]+\s*\w+(?:/[\d\.]+\s*\w+)?)\)", 2),
    "trade_name": (r"^([A-Z][A-Z0-9\s\-\.%]+?)(?:\s*\(|$)", 1),
    "dosage_form": (r"\)\s*([a-zA-Z][a-zA-Z\s\-]+?)(?:,\s*\d|\s*\((?:TPU|GPU|GPUID|VTM))", 1),
    "package_size": (r",\s*([\d\.]+)\s*([a-zA-Z]+(?:\s+[a-zA-Z]+)?)\s*\((?:TPU|GPU)", 1),
    "package_unit": (r",\s*([\d\.]+)\s*([a-zA-Z]+(?:\s+[a-zA-Z]+)?)\s*\((?:TPU|GPU)", 2),
}


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_c(c), F.lit(""))


def pad(c: Column | str, n: int) -> Column:
    """Left zeros up to ``n`` characters; longer text is kept whole."""
    text = _c(c).cast("string")
    return F.when(F.length(text) >= n, text).otherwise(F.lpad(text, n, "0"))


def strip0(c: Column | str) -> Column:
    return F.ltrim(_c(c).cast("string"), F.lit("0"))


def digits_key(c: Column | str) -> Column:
    """Only the digits, as a number; null when there are none."""
    return F.nullif(F.regexp_replace(_c(c).cast("string"), "[^0-9]", ""), F.lit("")).try_cast("bigint")


def prefix(c: Column | str, n: int) -> Column:
    return F.substring(_c(c), 1, n)


cut = prefix


def first_token(c: Column | str, sep: str = ",") -> Column:
    return F.split_part(_c(c), F.lit(sep), F.lit(1))


def first_digits(c: Column | str) -> Column:
    """The first run of digits as a number, 0 when there is none or it does not fit."""
    return F.coalesce(blank_to_null(F.regexp_extract(_c(c), r"(\d+)", 1)).try_cast("int"), F.lit(0))


def has(c: Column | str, part: str) -> Column:
    return F.coalesce(F.contains(_c(c), F.lit(part)), F.lit(False))


def like_escape(term: str) -> str:
    for ch in ("\\", "%", "_"):
        term = term.replace(ch, "\\" + ch)
    return term


def mask_text(c: Column | str) -> Column:
    out = _c(c)
    for pattern, shown in SECRET_PATTERNS:
        out = F.regexp_replace(out, "(?i)" + pattern, shown)
    return out


def redact_params(c: Column | str) -> Column:
    """Hide the values of a ``map<string,string>`` whose key contains a sensitive word."""

    def shown(key: Column, value: Column) -> Column:
        name, hit = F.lower(key), F.lit(False)
        for word in SECRET_KEYS:
            hit = hit | F.contains(name, F.lit(word))
        return F.when(hit, F.lit("***REDACTED***")).otherwise(value)

    return F.transform_values(_c(c), shown)


def parse_json(c: Column | str, schema: str = "map<string,string>") -> Column:
    return F.from_json(_c(c), schema)


def digest(c: Column | str, algorithm: str = "sha256") -> Column:
    return F.sha2(_c(c), 256) if algorithm == "sha256" else F.md5(_c(c))


def clean_cell(c: Column | str, width: int | None = None, is_id: bool = False) -> Column:
    """One spreadsheet cell: first non-blank line, trimmed, empty markers to null, cut to width.

    Hardly any cell has a line break, so only those with one are read by a pattern, which has to go
    back and forth; the others are trimmed.
    """
    cell = _c(c)
    empty = "|".join(w for w in EMPTY_CELLS if w)
    tail = r"(?:\.0)?" if is_id else ""
    line = rf"^\s*+(?!(?:{empty})?\s*(?:\n|$))([^\n]*?){tail}\s*(?:\n|$)"
    plain = F.btrim(cell, F.lit(" \t\x0b\f\r"))
    whole = F.when(plain.isin(*EMPTY_CELLS), F.lit("")).otherwise(plain)
    if is_id:
        whole = F.when(F.endswith(whole, F.lit(".0")), F.left(whole, F.length(whole) - 2)).otherwise(whole)
    text = blank_to_null(F.when(F.contains(cell, F.lit("\n")), F.regexp_extract(cell, line, 1)).otherwise(whole))
    return F.substring(text, 1, width) if width else text


def to_ts(c: Column | str) -> Column:
    """``d/M/yyyy`` with or without ``H:m:s`` to a timestamp, anything else null.

    The text is rearranged to ISO order and cast: a cast reads it once and, unlike a format parser,
    does not raise inside on every unreadable cell.
    """
    shape = r"(?s)^(?:(\d{1,2})/(\d{1,2})/(\d{4})( \d{1,2}:\d{1,2}:\d{1,2})?|.*)$"
    return F.regexp_replace(F.trim(_c(c)), shape, "$3-$2-$1$4").try_cast("timestamp")


def slash_date(c: Column | str) -> Column:
    """``d/M/yyyy`` to a date; a year above 2500 is Buddhist era."""
    parts = F.split(F.trim(_c(c)), "/")
    year = F.get(parts, F.lit(2)).try_cast("int")
    year = F.when(year > 2500, year - 543).otherwise(year)
    iso = F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"), pad(F.get(parts, F.lit(1)), 2), pad(F.get(parts, F.lit(0)), 2)
    )
    return F.when((F.size(parts) == 3) & year.isNotNull(), iso.try_cast("date"))


def compact_date(c: Column | str) -> Column:
    """``yyyyMMdd`` given as a number or text."""
    text = _c(c).cast("string")
    return F.regexp_replace(text, r"(?s)^(?:(\d{4})(\d{2})(\d{2})|.*)$", "$1-$2-$3").try_cast("date")


def posting_key(c: Column | str) -> Column:
    """Sortable ``yyyymmdd`` from either that form or ``dd/mm/yyyy``."""
    t = _c(c)
    return (
        F.when(F.length(t) == 8, t)
        .when(F.length(t) == 10, F.concat(F.right(t, F.lit(4)), F.substring(t, 4, 2), F.substring(t, 1, 2)))
        .otherwise(t)
    )


def unwrap_formula(c: Column | str) -> Column:
    """``="32045"`` (a spreadsheet's text formula) to ``32045``; other text unchanged."""
    t = _c(c)
    pattern = r"^=[\"'](.*)[\"']\s*$"
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(t)


def scheme_of(c: Column | str) -> Column:
    kind = F.upper(_c(c))
    return (
        F.when(F.contains(kind, F.lit("LGO")), "LGO")
        .when(F.contains(kind, F.lit("SSS")), "SSS")
        .when(F.contains(kind, F.lit("OFC")), "OFC")
        .otherwise("UCS")
    )


def _found(c: Column, pattern: str, group: int) -> Column:
    return blank_to_null(F.regexp_extract(c, pattern, group))


def claim_file_parts(c: Column | str) -> dict[str, Column]:
    name = _c(c)
    return {
        "hospital_code": _found(name, CLAIM_FILE, 1),
        "file_type": _found(name, CLAIM_FILE, 2),
        "file_date": be_to_date(_found(name, CLAIM_FILE, 3)),
        "sequence": _found(name, CLAIM_FILE, 4),
    }


def statement_file_parts(c: Column | str) -> dict[str, Column]:
    name = _c(c)
    side = F.upper(_found(name, STATEMENT_FILE, 2))
    return {
        "hospital_code": _found(name, STATEMENT_FILE, 1),
        "file_type": F.concat(side, F.lit("_STM")),
        "scheme": F.upper(_found(name, STATEMENT_FILE, 3)),
        "statement_year": _found(name, STATEMENT_FILE, 4).try_cast("int"),
        "statement_month": _found(name, STATEMENT_FILE, 5).try_cast("int"),
        "sequence": _found(name, STATEMENT_FILE, 6),
    }


def drug_name_parts(c: Column | str) -> dict[str, Column]:
    """Generic name, strength, trade name, form and package from a drug's full name."""
    text = F.trim(_c(c))
    parts = {k: _found(text, p, g) for k, (p, g) in DRUG_PATTERNS.items()}
    parts = {k: F.trim(v) for k, v in parts.items()}
    parts["trade_name"] = F.regexp_replace(parts["trade_name"], r"\.+$", "")
    return parts


def quality_flags(year: Column, month: Column, hcode: Column, scheme: Column, filename: Column) -> dict[str, Column]:
    """Row-level checks of what a request would have to satisfy."""
    ok = {
        "ok_hospital": hcode.rlike(r"^\d{5}$"),
        "ok_month": month.between(1, 12),
        "ok_year": year.between(2560, 2600),
        "ok_scheme": scheme.isin("UCS", "OFC", "SSS", "LGO"),
        "ok_filename": filename.rlike(r"^[A-Za-z0-9_.-]+$") & ~F.contains(filename, F.lit("..")),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in ok.items()}
