"""String expressions whose results agree with Python's str and path rules.

Java's regular expressions differ: `(?U)` makes classes Unicode-aware, `(?d)` lets only \\n end a
line, `\\z` is the end of the text.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = str | Column

#: What Python strips: Unicode white space and the four separators U+001C..1F.
SPACE = r"[\s\x1c-\x1f]"


def _col(text: Text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def strip(text: Text) -> Column:
    """The text without white space at both ends."""
    return F.regexp_replace(_col(text), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def split_words(text: Text) -> Column:
    """The runs between white space; none for blank text."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)([^\s\x1c-\x1f]+)"), F.lit(1))


def tokens(text: Text) -> Column:
    """Search tokens in lower case: an ASCII letter or underscore, then word characters of any script. Null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(text)), F.lit(r"([a-zA-Z_][\p{L}\p{N}_]*)"), F.lit(1)), F.array().cast("array<string>"))


def base_name(path: Text) -> Column:
    return F.substring_index(_col(path), "/", -1)


def suffix(name: Text) -> Column:
    """The ending with its dot, as a path library gives it: none for `.py`, `a.` or `name`."""
    return F.regexp_extract(base_name(name), r"(?<=.)(\.[^.]+)\z", 1)


def stem(path: Text) -> Column:
    """The last part of a path without its ending."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+\z", "")


def line_count(text: Text) -> Column:
    """Line ends plus one."""
    return F.length(_col(text)) - F.length(F.replace(_col(text), F.lit("\n"), F.lit(""))) + 1


def auto_title(question: Text, limit: int = 50) -> Column:
    """A chat's title: the question, or its first `limit` characters without the last, cut word and with dots."""
    q = strip(question)
    return F.when(F.length(q) > limit, F.concat(F.regexp_replace(F.left(q, F.lit(limit)), r" [^ ]*\z", ""), F.lit("..."))).otherwise(q)


def cache_key(query: Text, project: Text | None = None) -> Column:
    """16 hex digits for a query within a project; an empty or null project counts as `default`."""
    key = _col(query)
    if project is not None:
        key = F.concat_ws(":", F.coalesce(F.nullif(_col(project), F.lit("")), F.lit("default")), key)
    return F.substring(F.sha2(key, 256), 1, 16)


def first_hop(forwarded: Text, address: Text) -> Column:
    """The first address of a forwarded-for list, else the peer's own."""
    return F.coalesce(F.nullif(F.trim(F.split_part(_col(forwarded), F.lit(","), F.lit(1))), F.lit("")), _col(address))


def valid_query(query: Text) -> Column:
    """1 to 2000 characters."""
    return F.coalesce(F.length(_col(query)).between(1, 2000), F.lit(False))


def valid_client(client: Text) -> Column:
    """16 to 64 letters, digits or hyphens."""
    return F.coalesce(_col(client).rlike(r"^[A-Za-z0-9-]{16,64}\z"), F.lit(False))
