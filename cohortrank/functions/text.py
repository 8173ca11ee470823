"""String expressions: folder names, league codes, composite keys, cell equality."""

from __future__ import annotations

import json
import sys
import unicodedata
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import to_number

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------
FOLDER_RE = r"^(\d+)\s*-\s*\[([A-Za-z]{2,3})\]\s*-\s*\((.+)\)$"
SEASON_RE = r"^\d{4}-\d{4}$"
KEY_SEPARATOR = " | "
KEY_NULL = "<NA>"
# ---------------------------------------------------------------------------


def _folded() -> dict[str, str]:
    """Non-ASCII character -> the ASCII part of its compatibility decomposition, where there is one."""
    out = {}
    for code in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= code <= 0xDFFF:
            plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
            if plain:
                out[chr(code)] = plain
    return out


FOLDED = _folded()
_ONE = {k: v for k, v in FOLDED.items() if len(v) == 1}
_MANY = {k: v for k, v in FOLDED.items() if len(v) > 1}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_folder(name) -> tuple[Column, Column, Column]:
    """``"<n> - [CODE] - (League)"`` -> (n, upper code, league); else (NULL, '', name)."""
    name = _c(name)
    ok = name.rlike(FOLDER_RE)
    num = F.when(ok, F.regexp_extract(name, FOLDER_RE, 1).cast("int"))
    code = F.when(ok, F.upper(F.regexp_extract(name, FOLDER_RE, 2))).otherwise(F.lit(""))
    league = F.when(ok, F.regexp_extract(name, FOLDER_RE, 3)).otherwise(name)
    return num, code, league


def league_code(country, league) -> Column:
    """``COUNTRY_`` + squashed league abbreviation, at most 7 characters.

    Upper-cased tokens ``[A-Za-z0-9]+``; a single token keeps its first five
    letters, otherwise each token gives its first character plus all its
    digits (so a leading digit repeats: ``2`` -> ``22``).
    """
    words = F.regexp_extract_all(F.upper(_c(league)), F.lit(r"([A-Za-z0-9]+)"), 1)
    n = F.size(words)
    parts = F.transform(words, lambda w: F.when(n == 1, F.substring(w, 1, 5))
                        .otherwise(F.concat(F.substring(w, 1, 1), F.regexp_replace(w, r"[^0-9]", ""))))
    return F.concat(_c(country), F.lit("_"), F.substring(F.array_join(parts, ""), 1, 7))


def composite_key(cols: Sequence, sep: str = KEY_SEPARATOR, null: str = KEY_NULL, numeric: Sequence[str] = ()) -> Column:
    """Trimmed text of each key column joined by `` | ``; NULL -> ``<NA>``.

    Columns named in ``numeric`` hold numbers: there 25 and 25.0 give the same
    key. Text is only trimmed, so ``007`` and ``7`` stay two keys.
    """
    parts = []
    for name in cols:
        c = _c(name)
        s = F.trim(c.cast("string"))
        if isinstance(name, str) and name in numeric:
            num = to_number(s)
            s = F.when(num.isNotNull() & (num == F.floor(num)) & (F.abs(num) < F.lit(1e15)),
                       F.floor(num).cast("long").cast("string")).otherwise(s)
        parts.append(F.coalesce(s, F.lit(null)))
    return F.concat_ws(sep, *parts)


def cells_equal(a, b) -> Column:
    """NULL = NULL; equal; equal as numbers; equal as trimmed text. Never NULL."""
    a, b = _c(a), _c(b)
    sa, sb = a.cast("string"), b.cast("string")
    na, nb = to_number(sa), to_number(sb)
    both_null = a.isNull() & b.isNull()
    one_null = a.isNull() | b.isNull()
    same = (sa == sb) | (na.isNotNull() & nb.isNotNull() & (na == nb)) | (F.trim(sa) == F.trim(sb))
    return F.when(both_null, F.lit(True)).when(one_null, F.lit(False)).otherwise(F.coalesce(same, F.lit(False)))


def cells_close(a, b, tol: float = 1e-9) -> Column:
    """Numbers equal within an absolute tolerance, or both NULL."""
    a, b = to_number(_c(a)), to_number(_c(b))
    return F.when(a.isNull() & b.isNull(), F.lit(True)).when(a.isNull() | b.isNull(), F.lit(False)) \
        .otherwise(F.abs(a - b) < F.lit(tol))


def safe_name(c, illegal: str = '<>:"/\\|?*') -> Column:
    """Illegal path characters -> '-', trimmed, trailing dots dropped."""
    s = F.translate(_c(c), illegal, "-" * len(illegal))
    return F.regexp_replace(F.trim(s), r"\.+$", "")


def slug(c) -> Column:
    """ASCII slug: accents folded, runs of non-word characters -> '_', ends trimmed.

    Every character that decomposes to ASCII is folded; those that become several
    letters (a ligature) are looked up once for each one that a text holds.
    """
    s = _c(c).cast("string")
    many = F.from_json(F.lit(json.dumps(_MANY)), "map<string,string>")
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(r"([^\x00-\x7F])"), 1))  # a class of all keys of ``many`` is slow to match
    found = F.filter(found, lambda x: F.map_contains_key(many, x))
    s = F.aggregate(found, s, lambda text, x: F.replace(text, x, F.try_element_at(many, x)))
    s = F.translate(s, "".join(_ONE), "".join(_ONE.values()))
    s = F.regexp_replace(s, r"[^\x00-\x7F]", "")
    s = F.regexp_replace(s, r"[^A-Za-z0-9_]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def split_scope(c) -> tuple[Column, Column]:
    """Split at the first ``". "`` only -> (area, name), both trimmed; no separator -> (text, '')."""
    c = _c(c)
    pat = r"^(.*?)\. (.*)$"
    has = c.rlike(pat)
    area = F.when(has, F.regexp_extract(c, pat, 1)).otherwise(c)
    rest = F.when(has, F.regexp_extract(c, pat, 2)).otherwise(F.lit(""))
    return F.trim(area), F.trim(rest)


def first_word(c, sep: str = " ") -> Column:
    """First word of a label."""
    return F.split_part(_c(c), F.lit(sep), F.lit(1))


def money_label(v) -> Column:
    """``1.2 M€`` (one decimal, a trailing ``.0`` dropped) from 1e6 up, ``300 k€`` below, dash for NULL.

    Halves round up, as the report page does.
    """
    v = _c(v)
    m = F.format_string("%.1f", F.floor(v / F.lit(1e5) + F.lit(0.5)) / F.lit(10.0))
    m = F.regexp_replace(m, r"\.0$", "")
    k = F.floor(v / F.lit(1000.0) + F.lit(0.5)).cast("long").cast("string")
    return (F.when(v.isNull(), F.lit("—"))
             .when(v >= F.lit(1e6), F.concat(m, F.lit(" M€")))
             .otherwise(F.concat(k, F.lit(" k€"))))


def natural_key(c) -> Column:
    """K6: order names with numbers naturally, as an array of text and digit runs.

    Text runs are lower-cased; digit runs are stripped of leading zeros and
    prefixed by their length, so ``2.`` comes before ``10.`` in any position.
    """
    runs = F.regexp_extract_all(F.concat(F.lit(" "), F.lower(_c(c))), F.lit(r"(\d+|\D+)"), 1)

    def part(x):
        digits = F.regexp_replace(x, r"^0+(?=\d)", "")
        return F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(x)
    return F.transform(runs, part)
