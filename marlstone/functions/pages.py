"""Body text of pages by the density of text and links in their blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content isn't text, elements that begin and end a block, and named characters.
HIDDEN = ["script", "style", "noscript", "template", "svg", "title", "select", "textarea"]
BLOCKS = [
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
]
BESIDE = ["nav", "footer", "aside"]
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "deg": "°",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«",
    "raquo": "»", "middot": "·", "bull": "•", "euro": "€", "pound": "£", "times": "×", "auml": "ä", "ouml": "ö",
    "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "agrave": "à", "ccedil": "ç", "egrave": "è",
    "eacute": "é", "ecirc": "ê",
}

#: Words of a class or id that say that a block isn't body text; our own choice.
BESIDE_NAMES = ["ad", "ads", "advert", "sponsor", "promo", "cookie", "sidebar", "menu"]
SPACE = r"[ \t\n\r\f]"
# Marks in a page without tags: a block's edge, a heading's, a link's beginning and end, a block beside the body.
EDGE, HEAD, LINK, UNLINK, ASIDE = "\x01", "\x02", "\x03", "\x04", "\x05"
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});"
WORDS = r"[^ \t\n\r\f]+"


def hidden(never_back: str = "+") -> str:
    """Comments, and elements whose content isn't text, to their end or the page's."""
    ends = "|".join(f"<{name}{rest_of_tag(never_back)}.*?(?:</{name}{SPACE}*>|\\z)" for name in HIDDEN)
    return rf"(?is)<!--.*?(?:-->|\z)|{ends}"


def rest_of_tag(never_back: str = "+") -> str:
    """What follows a tag's name: quoted values may hold >. Loops of the JVM never go back (+), so that long tags need no
    stack; the same texts match without it."""
    n = never_back
    return rf"(?:(?:{SPACE}|/)(?:[^<>\"']|\"[^\"]*{n}\"|'[^']*{n}')*{n})?{n}>"


def replacements(never_back: str = "+") -> list[tuple[str, str]]:
    """Patterns and what takes their place, in this order."""
    tag = rest_of_tag(never_back)
    return [
        (r"[\x01-\x08\x{00A0}]", " "),
        (hidden(never_back), " "),
        (rf"(?i)<(?:{'|'.join(BESIDE)}){tag}", EDGE + ASIDE),
        (rf"(?i)<(?:{'|'.join(BLOCKS)})(?:{SPACE}[^<>]*)?{SPACE}(?:class|id)=[\"'](?:[^\"'<>]* )?(?:{'|'.join(BESIDE_NAMES)})[ \"'][^<>]*>", EDGE + ASIDE),
        (rf"(?i)<h[1-6]{tag}", EDGE + HEAD),
        (rf"(?i)</?(?:h[1-6]|{'|'.join(BLOCKS)}){tag}", EDGE),
        (rf"(?i)<a{tag}", LINK),
        (rf"(?i)</a{tag}", UNLINK),
        (rf"(?i)<br{tag}", " "),
        (rf"<[a-zA-Z/!?][a-zA-Z0-9:-]*{never_back}{tag}|<[a-zA-Z/!?][^<>]*>", ""),
    ]


def unescaped(text: Column) -> Column:
    """Character references by name (those in ENTITIES) or number in place of what they stand for, each once; what isn't
    one stays. Numbers that aren't characters stay too."""

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, ENTITY, 1)
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        number = F.when(hexadecimal, F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("long")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        by_number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        known = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
        found = F.when(name == "", F.lit(None)).when(name.startswith("#"), by_number).otherwise(F.try_element_at(known, name))
        return F.when(found.isNotNull(), F.concat(found, F.regexp_replace(piece, ENTITY, ""))).otherwise(F.concat(F.lit("&"), piece))

    def joined(pieces: Column) -> Column:
        return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one), ""))

    # an array of one element, so that the text is split once
    split = F.transform(F.array(F.split(text, "&")), joined)[0]
    return F.when(text.contains("&"), split).otherwise(text)


def page_blocks(html: Column, least: int = 12) -> Column:
    """The blocks of a page in order: text, words, links (words in links), heading, kept. A null page has null.

    A block is dense if it has at least `least` words, of which less than a third in links; it is a list of links if a
    third or more are in links, or if it is text directly in an element that is beside the body by its name (BESIDE) or the
    name of its class or id (BESIDE_NAMES). Dense blocks are body text. A short block is, if the nearest blocks of those two kinds
    are dense on both sides; a heading if the next one is. Blocks without words are left out. A link that goes over several
    blocks counts in its first."""
    marked = html
    for pattern, to in replacements():
        marked = F.regexp_replace(marked, pattern, to)
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(WORDS), F.lit(0)))

    def measured(block: Column) -> Column:
        linked = F.array_join(F.regexp_extract_all(block, F.lit(f"{LINK}([^{UNLINK}]*)"), F.lit(1)), " ")
        flat = F.regexp_replace(block, f"[{HEAD}-{ASIDE}]", "")
        return F.struct(
            F.trim(F.regexp_replace(unescaped(flat), rf"{SPACE}+", " ")).alias("text"),
            count(flat).alias("words"),
            count(F.regexp_replace(linked, LINK, " ")).alias("links"),
            block.startswith(HEAD).alias("heading"),
            block.startswith(ASIDE).alias("beside"),
        )

    def kind(b: Column) -> Column:
        return F.when(b["beside"] | (3 * b["links"] >= b["words"]), "b").when(b["words"] >= least, "g").otherwise("s")

    def nearest(kinds: Column) -> Column:
        """At each place the kind of the nearest block before that isn't short (b at the start), in one pass."""
        step = lambda s, k: F.struct(F.when(k == "s", s["last"]).otherwise(k).alias("last"), F.concat(s["out"], s["last"]).alias("out"))
        return F.split(F.aggregate(kinds, F.struct(F.lit("b").alias("last"), F.lit("").alias("out")), step, lambda s: s["out"]), "")

    def judged(blocks: Column) -> Column:
        return F.transform(F.array(F.transform(blocks, kind)), lambda kinds: with_kept(blocks, kinds))[0]

    def with_kept(blocks: Column, kinds: Column) -> Column:
        rows = F.arrays_zip(blocks.alias("b"), kinds.alias("k"), nearest(kinds).alias("p"), F.reverse(nearest(F.reverse(kinds))).alias("n"))
        return F.transform(F.filter(rows, lambda r: r["k"].isNotNull()), decided)  # the split of "" has a part

    def decided(row: Column) -> Column:
        b, kept = row["b"], (row["k"] == "g") | ((row["k"] == "s") & (row["n"] == "g") & (row["b"]["heading"] | (row["p"] == "g")))
        return F.struct(*(b[f].alias(f) for f in ("text", "words", "links", "heading")), kept.alias("kept"))

    listed = F.filter(F.transform(F.split(marked, EDGE), measured), lambda b: b["words"] > 0)
    return F.when(html.isNotNull(), F.transform(F.array(listed), judged)[0])


def body_text(blocks: Column) -> Column:
    """The text of kept blocks, a line each."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["kept"]), lambda b: b["text"]), "\n")


def blocks_sql(table: str = "pages", key: str = "page_id", least: int = 12) -> str:
    """DuckDB SQL of page_blocks over a table: a row for each block (key, pos, text, words, links, heading, kept)."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    marked = "html"
    for pattern, to in replacements(""):
        written = "".join(f"' || chr({ord(c)}) || '" if c < " " else c for c in to)
        marked = f"regexp_replace({marked}, {quoted(pattern)}, '{written}', 'g')"
    name = f"regexp_extract(x, {quoted(ENTITY)}, 1)"
    names = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in ENTITIES.items())
    number = f"CASE WHEN {name}[2] IN ('x', 'X') THEN ('0x' || {name}[3:])::BIGINT ELSE {name}[2:]::BIGINT END"
    valid = f"CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr(({number})::INTEGER) END"
    found = f"CASE WHEN {name} = '' THEN NULL WHEN {name}[1] = '#' THEN {valid} ELSE CASE {name} {names} END END"
    text = f"list_aggregate(list_transform(string_split(flat, '&'), lambda x, i: CASE WHEN i = 1 THEN x ELSE coalesce({found} || regexp_replace(x, {quoted(ENTITY)}, ''), '&' || x) END), 'string_agg', '')"
    return rf"""WITH cut AS (SELECT {key}, generate_subscripts(parts, 1) AS pos, unnest(parts) AS part FROM (SELECT {key}, string_split({marked}, chr(1)) AS parts FROM {table})),
flat AS (SELECT {key}, pos, part, regexp_replace(part, '[\x02-\x05]', '', 'g') AS flat,
replace(array_to_string(regexp_extract_all(part, '\x03([^\x04]*)', 1), ' '), chr(3), ' ') AS linked FROM cut),
sized AS (SELECT {key}, pos, trim(regexp_replace({text}, '{SPACE}+', ' ', 'g')) AS text, len(regexp_extract_all(flat, '{WORDS}')) AS words,
len(regexp_extract_all(linked, '{WORDS}')) AS links, starts_with(part, chr(2)) AS heading,
starts_with(part, chr(5)) AS beside FROM flat),
kinds AS (SELECT *, CASE WHEN beside OR 3 * links >= words THEN 'b' WHEN words >= {least} THEN 'g' ELSE 's' END AS kind FROM sized WHERE words > 0),
near AS (SELECT *, coalesce(last_value(nullif(kind, 's') IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'b') AS before,
coalesce(first_value(nullif(kind, 's') IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 'b') AS after FROM kinds)
SELECT *, kind = 'g' OR (kind = 's' AND after = 'g' AND (heading OR before = 'g')) AS kept FROM near"""
