"""Tests on lines and labels. Each takes SQL text for a string and gives SQL text for a boolean, unless it says otherwise."""

from __future__ import annotations

from spanloom.functions.dialect import BLANK, ND, NW, WS, Spark
from spanloom.functions.text import DOTLIKE, dotted, fold, n_words, strip

#: Kinds of blocks, whether they are shown, and whether they are spoken (fixed values).
BLOCK_KINDS = (
    ("heading", True, True),
    ("paragraph", True, True),
    ("list_item", True, True),
    ("block_quote", True, True),
    ("code", True, False),
    ("index_entry", True, False),
    ("toc_entry", False, False),
    ("page_number", False, False),
    ("running_head", False, False),
    ("separator", False, False),
)
#: Headings that stand alone, of any part of a book (fixed values).
STANDALONE = (
    "contents", "table of contents", "prologue", "epilogue", "introduction", "foreword", "preface", "afterword", "acknowledgements",
    "acknowledgments", "appendix", "glossary", "bibliography", "notes", "index", "about the author",
)
CONTENTS = ("contents", "table of contents")
OPENINGS = ("prologue", "introduction", "foreword", "preface", "acknowledgements", "acknowledgments")
#: Titles of index pages (fixed values).
INDEX_TITLES = ("index", "subject index", "name index")
#: Abbreviations after which a sentence goes on (fixed values).
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "vs.", "etc.", "e.g.", "i.e.", "u.s.", "u.k.")
#: Words that carry no meaning of their own in a label (fixed values).
STOPWORDS = (
    "the", "and", "a", "an", "to", "of", "in", "on", "for", "with", "at", "by", "from", "as", "is", "are", "was", "were", "be", "been", "it", "that",
    "this", "these", "those", "i", "you", "we", "they", "he", "she", "not", "or", "but", "if", "then", "so", "no", "yes",
)
JOIN_WORDS = (
    "when", "without", "within", "while", "whereas", "because", "since", "although", "though", "however",
)

SENTENCE_END = r"[.!?:;,]$"
ROMAN = "[ivxlcdm]+"


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def is_blank(d: Spark, s: str) -> str:
    return f"({strip(d, s)} = '')"


def is_folio(d: Spark, s: str) -> str:
    """A page number alone, with ``page`` before it, or in roman letters; marks may be around it."""
    t = strip(d, s)
    return f"({t} <> '' and ({d.has(t, rf'(?i)^{NW}*page{WS}+{ND}+{NW}*$')} or {d.has(t, rf'^{NW}*{ND}{{1,4}}{NW}*$')} or {d.has(t, rf'(?i)^{NW}*{ROMAN}{NW}*$')}))"


def has_leader(d: Spark, s: str) -> str:
    """Two full stops together, or four with spaces between."""
    t = strip(d, dotted(d, s))
    return f"({d.has(t, '[.]{2}')} or {d.has(t, rf'(?:{WS}*[.]{WS}*){{4}}')})"


def is_contents_entry(d: Spark, s: str) -> str:
    """Four full stops in a row, or any leader and a page number at the end that no letter touches."""
    t = strip(d, dotted(d, s))
    return f"({d.has(t, rf'(?:[.]{WS}*){{4}}')} or ({has_leader(d, s)} and {d.has(t, rf'(?i)(^|[^A-Za-z])({ND}{{1,4}}|{ROMAN}){WS}*$')}))"


def is_wrapped_entry(d: Spark, s: str, following: str) -> str:
    """A contents entry whose leader or page stands alone on the line after it."""
    f = strip(d, dotted(d, f"coalesce({following}, '')"))
    alone = f"({has_leader(d, f)} and {d.has(f, f'^[.{BLANK}]+$')}) or {d.has(f, f'(?i)^(?:{ND}+|{ROMAN})$')}"
    return f"({strip(d, s)} <> '' and {f} <> '' and ({alone}))"


def is_index_line(d: Spark, s: str) -> str:
    """A line that an essay index can have: blank, an entry, an outline number, a short title, or few words in capitals."""
    t = strip(d, dotted(d, s))
    entry = f"({has_leader(d, t)} and {d.has(t, rf'(?i)(?:{ND}+|{ROMAN}){WS}*$')})"
    return f"({t} = '' or {entry} or {d.has(t, rf'^{ND}+(?:[.]{ND}+){{0,99}}$')} or ({n_words(d, t)} <= 6 and not {d.has(t, rf'[.!?]{WS}*$')}) or ({t} = upper({t}) and {n_words(d, t)} <= 8))"


def may_have_leader(d: Spark, s: str) -> str:
    """Two full stops with nothing but blanks between, as every leader has: what is tested before a leader is looked for in all lines of a text."""
    return d.has(s, f"[.{DOTLIKE}]{WS}*[.{DOTLIKE}]")


def is_artefact(d: Spark, s: str) -> str:
    return f"({is_folio(d, s)} or {is_contents_entry(d, s)})"


def is_rule(d: Spark, s: str) -> str:
    """Three or more dashes, stars or underscores, alone on the line."""
    one = "|".join(rf"[{c}](?:{WS}*[{c}]){{2}}[{BLANK}{c}]*" for c in ("-", "*", "_"))
    return d.has(s, rf"^{WS}{{0,3}}(?:{one})$")


def is_short(d: Spark, s: str, most: int = 12) -> str:
    """At most so many words. Spark splits off no more than decide, and an empty part at either end."""
    if d.name == "spark":
        return f"(size(filter(split({s}, {d.lit(WS + '+')}, {most + 3}), x -> x <> '')) <= {most})"
    return f"({n_words(d, s)} <= {most})"


def is_shouted(d: Spark, s: str) -> str:
    """Letters, and none of them small. Spark puts a text without small ones of ASCII in capitals, and no other."""
    if d.name == "spark":
        return f"({d.has(s, '[A-Z]')} and not {d.has(s, '[a-z]')} and {s} = upper({s}))"
    return f"({d.has(s, '[A-Za-z]')} and {s} = upper({s}))"


def ends_sentence(d: Spark, s: str) -> str:
    return d.has(s, SENTENCE_END)


def bare(d: Spark, s: str) -> str:
    """A title for comparison: no full stops at its end, no case."""
    return fold(d, d.sub(strip(d, s), "[.]+$"))


def is_division(d: Spark, s: str) -> str:
    """A title that every book may have, or the number of a part."""
    return f"({is_standalone(d, s)} or {is_numbered_division(d, s)})"


def is_standalone(d: Spark, s: str) -> str:
    return f"{bare(d, s)} in {listed(STANDALONE)}"


#: What the number of a part of a book follows (fixed values).
NUMBERED = ("chapter", "part", "book", "section", "appendix", "volume")


def is_numbered_division(d: Spark, s: str) -> str:
    return numbered(d, s, NUMBERED)


def may_be_numbered(d: Spark, s: str) -> str:
    """The name of a part at the beginning of a stripped text: what is tested in all lines before a number is looked for."""
    return d.has(f"left({s}, {max(map(len, NUMBERED))})", f"(?i)^(?:{'|'.join(NUMBERED)})")


def numbered(d: Spark, s: str, names) -> str:
    return d.has(strip(d, s), rf"(?i)^(?:{'|'.join(names)})[{BLANK}.:-]+[^\s]")


def is_contents_title(d: Spark, s: str) -> str:
    return f"({bare(d, s)} in {listed(CONTENTS)})"


def is_opening(d: Spark, s: str) -> str:
    """A title with which the body of a book begins."""
    return f"({strip(d, s)} <> '' and ({bare(d, s)} in {listed(OPENINGS)} or {numbered(d, s, ('chapter', 'part', 'book', 'section', 'volume'))}))"


def is_title_like(d: Spark, s: str) -> str:
    return f"({s} <> '' and {is_short(d, s)} and not {ends_sentence(d, s)})"


def in_margin(top: str, bottom: str, height: str) -> str:
    """In the top or bottom 12 percent of the page."""
    return f"({height} > 0 and ({top} <= {height} * 0.12 or {bottom} >= {height} - {height} * 0.12))"


def is_large(d: Spark, text: str, size: str, bold: str, body: str) -> str:
    """A heading by its looks: at most 20 words, larger than the body's type or bold. Spark counts words only where the type is so."""
    if d.name == "spark":
        looks = f"{body} > 0 and ({size} >= {body} * 1.15 or ({bold} and {size} >= {body}))"
        return f"(case when {looks} and {strip(d, text)} <> '' then {is_short(d, text, 20)} else false end)"
    return f"({strip(d, text)} <> '' and {n_words(d, text)} <= 20 and {body} > 0 and ({size} >= {body} * 1.15 or ({bold} and {size} >= {body})))"


def is_paragraph_line(d: Spark, s: str) -> str:
    t = strip(d, s)
    return f"({n_words(d, t)} >= 3 and {t} <> upper({t}) and ({d.has(t, '[.!?]$')} or {n_words(d, t)} >= 14 or length({t}) >= 90))"


def is_reasonable_heading(d: Spark, s: str) -> str:
    t = strip(d, s)
    colons = f"length({t}) - length(replace({t}, ':', ''))"
    return f"(length({t}) between 3 and 80 and not {d.has(t, '[.]$')} and {d.has(t, '[' + chr(92) + 'p{L}]')} and {colons} <= 1)"


def is_weak_label(d: Spark, s: str) -> str:
    """At most two words, half of them without meaning."""
    w = words_of(d, s)
    weak = d.keep(w, lambda x: f"{fold(d, d.sub(x, chr(94) + QUOTES + '+|' + QUOTES + '+$'))} in {listed([*STOPWORDS, *JOIN_WORDS])}")
    return f"({strip(d, s)} = '' or ({d.size(w)} <= 2 and 2 * {d.size(weak)} >= {d.size(w)}))"


QUOTES = r"[\x22\x27]"


def words_of(d: Spark, s: str) -> str:
    return d.keep(d.split(s, f"{WS}+"), lambda x: f"{x} <> ''")


def ends_abbreviated(d: Spark, s: str) -> str:
    """Whether a text ends as an abbreviation does; the ending need not be a word of its own."""
    return d.has(f"lower({strip(d, s)})", "(?:" + "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS) + ")$")


def markdown_kind(d: Spark, s: str) -> str:
    """The kind of a markdown line: fence, blank, heading, underline, rule, quote, item or text (a string)."""
    indent = rf"^{WS}{{0,3}}"
    return (
        f"case when {d.has(s, indent + '(?:`{3,}|~{3,})')} then 'fence' when {is_blank(d, s)} then 'blank'"
        f" when {d.has(s, indent + '#{1,6}' + WS)} then 'heading' when {d.has(s, indent + '(?:=+|-+)' + WS + '*$')} then 'underline'"
        f" when {is_rule(d, s)} then 'rule' when {d.has(s, indent + '>')} then 'quote'"
        f" when {d.has(s, rf'^{WS}*(?:[-*+]|{ND}+[.)]){WS}')} then 'item' else 'text' end"
    )


def markdown_level(d: Spark, s: str) -> str:
    """Level of a heading (1 to 6), of an underline (1 or 2), of an item (1 and one for each two spaces), else 0."""
    marks = d.pick(s, rf"^{WS}{{0,3}}(#{{1,6}}){WS}", 1)
    indent = d.pick(s, rf"^({WS}*)(?:[-*+]|{ND}+[.)]){WS}", 1)
    kind = markdown_kind(d, s)
    return f"case {kind} when 'heading' then length({marks}) when 'underline' then case when {d.has(s, '=')} then 1 else 2 end when 'item' then 1 + length({indent}) {d.div} 2 else 0 end"


def voice_matches(d: Spark, name: str, region: str, sex: str) -> str:
    """A voice of that region and sex; a name that says neither passes."""
    parsed = d.has(name, "^[ab][fm]_")
    return f"(not {parsed} or substr({name}, 1, 2) = concat({region}, {sex}))"
