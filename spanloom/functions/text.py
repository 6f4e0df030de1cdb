"""Text functions: normalisation, clean-up for speech, keys, ids."""

from __future__ import annotations

from spanloom.functions.dialect import BLANK, ND, NW, WS, Spark, Steps

#: Characters that count as a full stop (fixed values).
DOTLIKE = "\u2024\u2219\u00b7\uff0e\ufe52"
#: What ends a line for text that is split into lines of any kind (fixed values).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
#: The same but for carriage returns and line feeds, as characters of a class.
OTHER_ENDS = r"\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"

WORD_RUN = r"[\p{L}\p{N}_]+"

#: British words in -our, spoken in -or (fixed values).
OUR_WORDS = (
    "behaviour", "behaviours", "behavioural", "behaviourally", "colour", "colours", "coloured", "colouring", "colourful", "favour", "favours", "favoured",
    "favouring", "favourite", "favourites", "honour", "honours", "honoured", "honourable", "dishonour", "humour", "humours", "humourless", "labour",
    "labours", "laboured", "labourer", "labourers", "neighbour", "neighbours", "neighbourhood", "neighbouring", "rumour", "rumours", "rumoured", "flavour",
    "flavours", "flavoured", "endeavour", "endeavours", "harbour", "harbours", "armour", "glamour", "valour", "odour", "odours", "candour", "vigour",
    "rigour", "ardour", "fervour", "splendour", "tumour", "tumours",
)
#: British words in -re, spoken in -er (fixed values).
RE_WORDS = (
    "centre", "centres", "centred", "theatre", "theatres", "litre", "litres", "fibre", "fibres", "calibre", "lustre", "metre", "metres", "kilometre",
    "kilometres",
)
#: Suffixes in -is-, in the order in which they are tried; what they become; least length of the stem (fixed values).
IS_SUFFIXES = (
    ("isationally", "izationally", 1),
    ("isational", "izational", 1),
    ("isations", "izations", 1),
    ("isation", "ization", 1),
    ("isers", "izers", 1),
    ("iser", "izer", 1),
    ("ising", "izing", 1),
    ("ised", "ized", 1),
    ("ise", "ize", 4),
)


def strip(d: Spark, s: str) -> str:
    """Without blanks around. Spark's columns are looked through only where their first or last character is one."""
    if s in d.stripped:
        return s
    out = d.sub(s, f"^{WS}+|{WS}+$")
    if d.name == "spark" and s.isidentifier():
        return f"case when {d.has(f'concat(left({s}, 1), right({s}, 1))', WS)} then {out} else {s} end"
    return out


def rstrip(d: Spark, s: str) -> str:
    return d.sub(s, f"{WS}+$")


def squash(d: Spark, s: str) -> str:
    return d.sub(s, f"{WS}+", " ")


def fold(d: Spark, s: str) -> str:
    """Lower case for comparisons; sharp s is two letters."""
    return f"replace(lower({s}), 'ß', 'ss')"


def dotted(d: Spark, s: str) -> str:
    """Dot-like characters as full stops."""
    return f"translate({s}, '{DOTLIKE}', '{'.' * len(DOTLIKE)}')"


def words(d: Spark, s: str) -> str:
    return d.keep(d.split(s, f"{WS}+"), lambda x: f"{x} <> ''")


def n_words(d: Spark, s: str) -> str:
    return d.size(words(d, s))


def line_feeds(d: Spark, s: str) -> str:
    return d.sub(s, r"\r\n?", "\n")


def normalize_text(d: Spark, s: str) -> str:
    """One kind of line end and of space, at most one blank line in a row, nothing around."""
    s = d.sub(d.sub(line_feeds(d, s), r"\x{a0}", " "), r"[ \t]+", " ")
    return strip(d, d.sub(s, r"\n{3,}", "\n\n"))


def normalize_markdown(d: Spark, s: str) -> str:
    """The same, with indentation and inner spaces as they are; blanks at line ends go."""
    s = d.sub(d.sub(line_feeds(d, s), r"\x{a0}", " "), r"[ \t]+(\n|$)", "\\1")
    return strip(d, d.sub(s, r"\n{3,}", "\n\n"))


def dehyphenate(d: Spark, s: str) -> str:
    """Soft hyphens go, hard ones are plain, and a word broken over two lines is joined if it goes on in lower case."""
    s = f"replace(replace({s}, '\u00ad', ''), '\u2011', '-')"
    return d.sub(s, r"([a-zA-Z])-\n([a-z])", "\\1\\2")


def normalize_chunk(d: Spark, s: str) -> str:
    s = d.sub(d.sub(line_feeds(d, s), r"[\t\x{a0}]+", " "), " +", " ")
    return strip(d, d.sub(s, r"\n{3,}", "\n\n"))


def repetition_key(d: Spark, s: str) -> str:
    """What repeated lines have in common: no digits, no case, single spaces."""
    return squash(d, fold(d, strip(d, d.sub(s, f"{ND}+"))))


def match_key(d: Spark, s: str) -> str:
    """What is compared when a text is located in another: no white space, no soft hyphens, one kind of hyphen."""
    return f"replace({d.sub(s, WS + '|' + chr(0xAD))}, '\u2011', '-')"


def label_key(d: Spark, s: str) -> str:
    return fold(d, squash(d, strip(d, s)))


def marker_key(d: Spark, s: str) -> str:
    """A line's key for comparing it with a title: no dashes, no marks at its ends, no bracket at its end."""
    s = strip(d, squash(d, f"translate({label_key(d, s)}, '-\u2013\u2014', '   ')"))
    edge = r"[^\p{L}\p{N}]+"
    s = d.sub(d.sub(s, f"^{edge}"), f"{edge}$")
    return strip(d, d.sub(s, rf"{WS}*\([^)]*\){WS}*$"))


def punctuation(d: Spark, s: str) -> str:
    """Ellipses and leaders become one full stop; a full stop on its own becomes a space."""
    s = dotted(d, f"replace({s}, '\u2026', '...')")
    return d.sub(d.sub(s, r"\.{2,}", "."), rf"{WS}+\.{WS}+", " ")


def spoken_lines(d: Spark, s: str) -> str:
    """The lines that are spoken, joined: neither rules nor bare numbers, and without their outline number."""
    lines = d.split(s, LINE_END)
    number = rf"{WS}*{ND}+(?:\.{ND}+){{0,99}}"
    rule = rf"^[{BLANK}\x{{2013}}\x{{2014}}\x{{2212}}_*=~-]+$"
    kept = d.keep(lines, lambda x: f"not {d.has(strip(d, x), rule)} and not {d.has(x, f'^{number}{WS}*$')}")
    cleaned = d.each(kept, lambda x: strip(d, d.sub(x, f"^{number}{WS}+")))
    return strip(d, d.join(d.keep(cleaned, lambda x: f"{x} <> ''"), " "))


def initialisms(d: Spark, s: str) -> str:
    """``U.K.`` and runs of two to six capitals (with a plural s) are spelt with spaces.

    The text is cut into dotted initials, words, and the rest; initials that go on from a word are none. An engine that
    can look back needs no words: what is neither initials nor a run of capitals is a few long pieces.
    """
    initials = r"(?:[A-Z]\.){2,6}"
    if d.name == "spark":
        parts = d.find_all(s, rf"(?<![\p{{L}}\p{{N}}_]){initials}|[^A-Z]+|[A-Z]")
        s = d.join(d.each(parts, lambda x: f"case when length({x}) > 1 and {d.has(x, '^[A-Z]')} then rtrim(replace({x}, '.', ' ')) else {x} end"), "")
        runs = d.find_all(s, r"(?<![A-Za-z])[A-Z]{2,6}s?(?![A-Za-z])|[^A-Z]+|[A-Z]")
        return d.join(d.each(runs, lambda x: f"case when length({x}) > 1 and {d.has(x, '^[A-Z]')} then rtrim({d.sub(x, '(.)', chr(92) + '1 ')}) else {x} end"), "")
    parts = d.find_all(s, rf"{initials}|{WORD_RUN}|{NW}+")

    def dots(x: str) -> str:
        letters = d.find_all(x, "[A-Z]")
        return f"case when {d.has(x, f'^{initials}$')} then {d.join(letters, ' ')} else {x} end"

    s = d.join(d.each(parts, dots), "")
    runs = d.find_all(s, r"[A-Za-z]+|[^A-Za-z]+")

    def capitals(x: str) -> str:
        head = d.sub(x, "s$")
        plural = f"case when {d.has(x, 's$')} then ' s' else '' end"
        return f"case when {d.has(x, '^[A-Z]{2,6}s?$')} then concat({d.join(d.chars(head), ' ')}, {plural}) else {x} end"

    return d.join(d.each(runs, capitals), "")


def sanitize(d: Spark, s: str) -> str:
    """A text as it is spoken."""
    return strip(d, squash(d, initialisms(d, punctuation(d, spoken_lines(d, s)))))


def american(d: Spark, s: str) -> str:
    """Spellings that the speech model knows: words are looked up one by one, first by suffix and then in the two lists."""
    dash = d.sub(s, r"([a-zA-Z])\x{2011}([a-z])", "\\1\\2")
    dash = f"replace(replace({dash}, '\u2011', '-'), '\u2012', '-')"
    dash = f"replace(replace({dash}, '\u2013', ' - '), '\u2014', ' - ')"
    parts = d.find_all(dash, rf"{WORD_RUN}|{NW}+")

    def word(x: str) -> str:
        for suffix, to, least in IS_SUFFIXES:
            x = d.sub(x, rf"(?i)^([\p{{L}}\p{{N}}_]{{{least},}}){suffix}$", f"\\1{to}")
        return x

    def listed(x: str) -> str:
        low = f"lower({x})"
        our, er = (", ".join(f"'{w}'" for w in words) for words in (OUR_WORDS, RE_WORDS))
        ends = d.sub(d.sub(low, "red$", "ered"), "re(s?)$", "er\\1")
        return f"case when {low} in ({our}) then replace({low}, 'our', 'or') when {low} in ({er}) then {ends} else {x} end"

    return d.join(d.each(d.each(parts, word), listed), "")



def title_case(d: Spark, s: str) -> str:
    """Each run of letters with a capital first and small letters after it."""
    runs = d.find_all(s, r"\p{L}+|[^\p{L}]+")
    return d.join(d.each(runs, lambda x: f"concat(upper(substr({x}, 1, 1)), lower(substr({x}, 2)))"), "")


def safe_stem(d: Spark, s: str) -> str:
    """A file name of letters, digits, dashes and underscores, 80 characters at most; ``book`` for nothing."""
    name = d.sub(strip(d, s), r"[^\p{L}\p{N}_-]", "_")
    return f"case when {strip(d, s)} = '' then 'book' else substr({name}, 1, 80) end"


def pinned(d: Spark, s: str) -> str:
    """A label as lists show it, with a pin before it, once."""
    t = strip(d, s)
    return f"case when {t} = '' then '📌' when instr({t}, '📌') = 1 then {t} else concat('📌 ', {t}) end"


def language_code(d: Spark, s: str, default: str = "b") -> str:
    """The speech engine's code of a language tag."""
    t = f"replace(lower({strip(d, s)}), '_', '-')"
    return f"case when {t} = 'en-gb' then 'b' when {t} = 'en-us' then 'a' else '{default}' end"


def book_id(d: Spark, title: str, text: str) -> str:
    return f"substr({d.sha256(f'concat({title}, substr({text}, 1, 2000))')}, 1, 16)"


def cache_id(d: Spark, text: str, start: str, engine: str) -> str:
    name = f"lower({strip(d, engine)})"
    return f"substr({d.sha256(f'''concat({text}, '|start=', cast({start} as {d.string}), '|engine=', {name}, '|v15')''')}, 1, 16)"


#: Inline marks and what is left of them, in the order in which they are taken off (fixed order). The last three look at
#: what stands beside them; an engine that can't look takes it along, and so goes over the text twice.
INLINE = (
    (r"!\[([^\]]*)\]\([^)]*\)", "\\1"),
    (r"\[([^\]]*)\]\([^)]*\)", "\\1"),
    (r"\[([^\]]*)\]\[[^\]]*\]", "\\1"),
    (r"`+([^`]*)`+", "\\1"),
    (r"(?s)~~(.+?)~~", "\\1"),
    (r"(?s)\*\*(.+?)\*\*", "\\1"),
)
LOOKING = (
    r"(?s)(?<![A-Za-z0-9_])__(.+?)__(?![A-Za-z0-9_])",
    r"(?s)(?<!\*)\*(?!\s)(.+?)(?<!\s)\*(?!\*)",
    r"(?s)(?<![A-Za-z0-9_])_(?!\s)(.+?)(?<!\s)_(?![A-Za-z0-9_])",
)
TAKING = (
    r"(?s)(^|[^A-Za-z0-9_])__(.+?)__($|[^A-Za-z0-9_])",
    r"(?s)(^|[^*])\*([^\s*]|[^\s*][^*]*?[^\s*])\*($|[^*])",
    r"(?s)(^|[^A-Za-z0-9_])_([^\s_]|[^\s_].*?[^\s_])_($|[^A-Za-z0-9_])",
)
#: Characters that a backslash keeps from being marks (fixed values). Meanwhile each is a sign and a private character;
#: a sign that the text has itself is followed by another one.
ESCAPABLE = "\\`*_{}[]()#+-.!>~|"
SIGN, OWN = chr(0xE0FF), chr(0xE1FF)
PARKED = [SIGN + chr(0xE100 + i) for i in range(len(ESCAPABLE))]


def inline_steps(d: Spark, s: str, out: str) -> Steps:
    """Steps to ``out``: the text of a line without its inline marks. A backslash before a mark keeps the mark."""
    parked = f"replace({s}, '{SIGN}', '{SIGN}{OWN}')"
    for c, p in zip(ESCAPABLE, PARKED, strict=True):
        parked = f"replace({parked}, {d.text(chr(92) + c)}, '{p}')"
    steps, last = [(f"{out}0", parked)], f"{out}0"
    looks = [(p, "\\1") for p in LOOKING] if d.name == "spark" else [(p, "\\1\\2\\3") for p in TAKING for _ in range(2)]
    for k, (pattern, to) in enumerate((*INLINE, *looks), 1):
        steps.append((f"{out}{k}", d.sub(last, pattern, to)))
        last = f"{out}{k}"
    back = last
    for c, p in zip(ESCAPABLE, PARKED, strict=True):
        back = f"replace({back}, '{p}', {d.text(c)})"
    return [*steps, (out, strip(d, f"replace({back}, '{SIGN}{OWN}', '{SIGN}')"))]
