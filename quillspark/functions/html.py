"""Text of HTML pages, by column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and what stands for their matches, in this order: what isn't text, line ends, other tags, white space.
MARKUP = (
    (r"(?is)<!--.*?-->|<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>", ""),
    (r"(?i)</?(?:p|div|br|hr|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|title|blockquote|pre)\b[^>]*>", "\n"),
    (r"<[a-zA-Z/!][^>]*>", ""),
)
#: Named entities, fixed values; those by number need no table.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "deg": "°", "times": "×", "euro": "€", "pound": "£",
    "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
}
ENTITY = "&(?:" + "|".join(ENTITIES) + "|#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7});"
SPACING = ((r"[\t\x0B\f\r ]+", " "), (r" ?\n[\n ]*", "\n"), (r"^[\n ]+|[\n ]+$", ""))


def _letter(entity: Column) -> Column:
    """What an entity stands for; a number that no letter has gives the replacement character."""
    named = F.create_map(*(F.lit(x) for name, letter in ENTITIES.items() for x in (f"&{name};", letter)))
    hexadecimal = F.lower(F.substring(entity, 3, 1)) == "x"
    body = F.regexp_replace(entity, "^&#[xX]?|;$", "")
    code = F.when(hexadecimal, F.conv(body, 16, 10)).otherwise(body).cast("long")
    code = F.when((code > 0) & (code < 0xD800) | (code > 0xDFFF) & (code <= 0x10FFFF), code).otherwise(0xFFFD)
    return F.when(F.substring(entity, 2, 1) == "#", F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.element_at(named, entity))


def html_text(html: Column) -> Column:
    """The text that a page shows: scripts, styles, comments and tags go, blocks stand in lines of their own.

    Entities by name (ENTITIES) and by number are read in one pass, so nothing is read twice; others stay as they are.
    Null stays null; a page without text is empty.
    """
    for pattern, by in MARKUP:
        html = F.regexp_replace(html, pattern, by)
    between, found = F.split(html, ENTITY, -1), F.regexp_extract_all(html, F.lit(ENTITY), F.lit(0))
    html = F.array_join(F.zip_with(between, F.transform(found, _letter), lambda t, e: F.concat(t, F.coalesce(e, F.lit("")))), "")
    for pattern, by in SPACING:
        html = F.regexp_replace(html, pattern, by)
    return html


def html_text_sql(html: str) -> str:
    """The same in the SQL of the oracle."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, by in MARKUP:
        html = f"regexp_replace({html}, {quoted(pattern)}, {quoted(by)}, 'g')"
    named = "CASE e " + " ".join(f"WHEN {quoted(f'&{name};')} THEN {quoted(letter)}" for name, letter in ENTITIES.items()) + " END"
    code = "(CASE WHEN lower(e[3]) = 'x' THEN ('0x' || e[4:-2])::BIGINT ELSE e[3:-2]::BIGINT END)"
    letter = f"CASE WHEN e[2] <> '#' THEN {named} WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}::INT) ELSE chr(65533) END"
    html = f"(SELECT array_to_string(list_transform(list_zip(string_split_regex(h, {quoted(ENTITY)}), list_transform(regexp_extract_all(h, {quoted(ENTITY)}), lambda e: {letter})), lambda p: p[1] || coalesce(p[2], '')), '') FROM (SELECT {html} AS h))"
    for pattern, by in SPACING:
        html = f"regexp_replace({html}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return html
