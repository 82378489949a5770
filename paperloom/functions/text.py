"""Text functions as columns: cleaning, counting, splitting, hashing and line detectors.

Everything here is a JVM-side expression.  Each detector comes with the SQL of the same
test (``SQL``), in the pattern dialect that Java and RE2 read alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript reads it, as a Java pattern.
SPACE = r"(?U)[\s\x{FEFF}]+"
#: The same set for RE2.
SPACE_RE2 = r"[\s\v\x{0085}\p{Z}\x{FEFF}]+"
ALNUM = r"[\p{L}\p{N}]+"
LETTER = r"\p{L}"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


#: Printable ASCII, single blanks, none at the ends; loops are possessive, so that long texts need no stack.
PLAIN = r"\A(?:[!-~]++(?: [!-~]++)*+)?+\z"
#: The same without question marks.
PLAIN_CERTAIN = r"\A(?:[!->@-~]++(?: [!->@-~]++)*+)?+\z"
#: Printable ASCII at both ends.
PLAIN_ENDS = r"(?s)\A[!-~](?:.*[!-~])?\z"


def unless_plain(text: Column, plain: str, f) -> Column:
    """``f`` of a text, but a text of the pattern ``plain`` itself, which ``f`` would leave as it is: one pass instead of several."""
    return F.when(text.rlike(plain), text).otherwise(f(text))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


#: The edges of ASCII words, and the one before a letter or digit, which is all that may be before one.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
EDGE_BEFORE = "(?<![A-Za-z0-9_])"


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern that bars outside of groups and classes divide."""
    out, depth, in_class, k = [""], 0, False, 0
    while k < len(pattern):
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        in_class = (in_class or c == "[") and c != "]"
        depth += 0 if in_class else (c == "(") - (c == ")")
        if c == "|" and depth == 0 and not in_class:
            out.append("")
        elif depth < 0:
            return out
        else:
            out[-1] += c
        k += len(c)
    return out


def _begins_a_word(rest: str) -> bool:
    """Whether all that a pattern matches begins with an ASCII letter or digit."""
    group = "(?:" if rest.startswith("(?:") else "(" if rest.startswith("(") and not rest.startswith("(?") else ""
    if not group:
        return rest[:1].isascii() and rest[:1].isalnum() and rest[1:2] not in ("?", "*", "{")
    inside = alternatives(rest[len(group) :])
    after = rest[len(group) + len("|".join(inside)) + 1 :]
    return after[:1] not in ("?", "*", "{") and all(_begins_a_word(x) for x in inside)


def ascii_edges(pattern: str) -> str:
    """The pattern with word edges between ASCII letters, digits and _ alone, as ECMAScript and RE2 have them; Java's know all letters."""
    first, *parts = pattern.split(r"\b")
    edges = [EDGE_BEFORE if _begins_a_word(x) else EDGE for x in parts]
    return first + "".join(edge + x for edge, x in zip(edges, parts, strict=True))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, where Catalyst would copy its expression for every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def nonempty(text: Column) -> Column:
    """The text, or null if it is empty: absence is one thing everywhere."""
    return F.nullif(text, F.lit(""))


def first_nonempty(*texts: Column) -> Column:
    return F.coalesce(*[nonempty(t) for t in texts], F.lit(""))


def readable(text: Column) -> Column:
    """Without replacement signs and extra spaces; empty if question marks rule it."""

    def certain(clean: Column) -> Column:
        return F.when(count(clean, r"\?") >= F.greatest(F.lit(3.0), F.length(clean) * 0.35), "").otherwise(clean)

    return unless_plain(F.coalesce(text, F.lit("")), PLAIN_CERTAIN, lambda t: let(collapse(F.replace(t, F.lit("�"), F.lit(""))), certain))


def first_readable(*texts: Column) -> Column:
    """The first that is readable; one function over an array, as the code of each would be a copy."""
    clean = F.filter(F.transform(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), readable), lambda t: t != "")
    return F.coalesce(F.try_element_at(clean, F.lit(1)), F.lit(""))


def key_of(value: Column) -> Column:
    return unless_plain(F.lower(value), PLAIN, collapse)


def distinct_first(values: Column) -> Column:
    """Values whose key was not seen before, in order."""

    def first(vs: Column) -> Column:
        return let(F.transform(vs, key_of), lambda keys: F.filter(vs, lambda v, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1)))

    return let(values, first)


#: What separates the values of a list.
SEPARATORS = r"[;；,，、\n/|]+"
#: Those that say there is none.
NOTHING = r"(?i)^(none|n/a|null|无|暂无|-+)$"


def values_of(text: Column) -> Column:
    """Distinct values of a separated list: trimmed, 2 to 60 signs, none of ``NOTHING``."""
    parts = F.transform(F.split(text, SEPARATORS), lambda x: unless_plain(x, PLAIN_ENDS, stripped))
    kept = F.filter(parts, lambda x: F.length(x).between(2, 60) & ~x.rlike(NOTHING))
    return distinct_first(kept)


def people_of(text: Column) -> Column:
    """The values of a list of names, without "et al." (a fixed pattern)."""
    people = F.transform(values_of(text), lambda x: F.trim(F.regexp_replace(x, r"(?i)(?<![A-Za-z0-9_])et\s+al\.?", "")))
    return F.filter(people, lambda x: x != "")


#: Method names that are found as whole tokens, in this order.
METHOD_HINTS = ("PPO", "SAC", "DDPG", "TD3", "DQN", "RL", "PINN", "CBF", "MPC", "VLM", "World Model", "Transformer", "Diffusion", "PID", "QP", "RRT", "A*", "MCTS")


def methods_of(methods: Column, keywords: Column, english: Column, chinese: Column) -> Column:
    """Hinted methods named in any of the fields, then the listed ones, distinct."""
    source = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (methods, keywords, english, chinese)])
    token = lambda names: f"(?i)(^|[^A-Za-z0-9])(?:{names})([^A-Za-z0-9]|$)"
    plain = [h.replace("*", r"\*") for h in METHOD_HINTS]
    # Patterns are fixed, so each is compiled once; most texts name no method and need one search alone.
    each = lambda s: F.filter(F.array(*[F.when(s.rlike(token(p)), h) for p, h in zip(plain, METHOD_HINTS, strict=True)]), lambda h: h.isNotNull())
    hinted = let(source, lambda s: F.when(s.rlike(token("|".join(plain))), each(s)).otherwise(F.array().cast("array<string>")))
    return distinct_first(F.concat(hinted, values_of(F.coalesce(methods, F.lit("")))))


def truncated(text: Column, n: int) -> Column:
    """At most n signs, the last an ellipsis if anything was cut."""
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, r"sk-[A-Za-z0-9_-]{8,}", "[REDACTED_API_KEY]")


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1B\[[0-9;]*[A-Za-z]", "")


def html_escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def unfenced(text: Column) -> Column:
    """Without a code fence around the whole text."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?[ \t\r\n]*|[ \t\r\n]*```$", ""))


def json_part(text: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def ratio(text: Column, pattern: str) -> Column:
    return F.when(F.length(text) > 0, count(text, pattern) / F.length(text)).otherwise(0.0)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s) != "")


def _folded(text: Column, seed: int, step) -> Column:
    codes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    number = F.aggregate(codes, F.lit(seed).cast("long"), step)
    return F.lower(F.conv(number.cast("string"), 10, 36))


def fnv36(text: Column) -> Column:
    """32-bit FNV-1a over the code points, in base 36."""
    return _folded(text, 2166136261, lambda h, c: F.expr("0") + (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))


def poly36(text: Column) -> Column:
    """The polynomial hash of base 31 modulo 2**32, in base 36."""
    return _folded(text, 0, lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295)))


# -- detectors of a line ---------------------------------------------------------------
# Word lists, patterns and numeric bounds below are given by the results to match.


def words_like(text: Column, pattern: str, words: str = ALNUM) -> Column:
    """How many words of the text match the whole pattern."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(f"({words})"), 1), lambda w: w.rlike(f"^(?:{pattern})$")))


TITLE = r"\p{Lu}[\p{Ll}\p{L}\p{N}]*"
NAME = r"\p{Lu}\.|\p{Lu}\p{Ll}+"
PROSE = r"(?i:the|and|that|this|with|from|for|into|using|used|can|are|is|be|has|have|model|models|data|training|tasks)"
LABELS = r"(?i:data|model|prompt|metadata|subgoal|image|images|episode|policy|expert|instruction|instructions|robot|world|action)"
DIAGRAM = r"(?i:autonomous|data|demonstration|model|prompt|metadata|subgoal|image|images|episode|policy|expert|instruction|instructions|robot|world|action|multimodal)"
ACADEMIC = r"(?i:model|models|data|training|learning|robot|robots|policy|method|experiment|performance|capabilities)"
ACTIONS = r"(?i:open|close|pick|put|load|throw|fold|move|place|take|chop|pour|wipe|turn|press|push|pull)"
CONTRIBUTIONS = (
    "data collection and operations",
    "annotation and supplemental data",
    "policy training and research",
    "policy infrastructure",
    "robot hardware",
    "robot infrastructure",
    "writing and illustration",
)
MARKS = r"[.;:!?。！？]"
SECTION_NAME = r"(?i)^(abstract|introduction|related work|method|methods|experiments?|results?|discussion|conclusion|references)s?$"
SECTION_NUMBERED = r"^([IVX]+|\d+(?:\.\d+)*)\.?\s+\p{Lu}[\p{L}\p{N} ,:;()/-]{3,}$"
SECTION_LETTERED = r"^[A-Z]\.\s+\p{Lu}[\p{L}\p{N} ,:;()/-]{3,}$"
CAPTION = r"(?i)^(fig\.|figure|table)\s*\d*[:.]"
CAPITALS = r"^([IVX]+\.\s+)?[A-Z][A-Z0-9 ,:;()/-]{4,}$"
#: How each line begins, or is as a whole, whose drawn-together form may be a section's heading: a number, a letter with a point, a name of 13 signs at most.
MAY_BE_SECTION = r"^(?:[IVX\d][IVX\d.\s]*\p{Lu}|[A-Z]\.|(?:\s*+\S){1,13}+\s*+$)"
MATH = r"[=∑∫√∞≤≥≠≈→+\-*/^_{}\[\]()]"


def is_reference(t: Column) -> Column:
    t = stripped(t)
    return t.rlike(r"^\[\d+\]\s+") | t.rlike(r"^\d+\.\s+\p{Lu}[\p{L}.-]+,\s+\p{Lu}")


def is_bibliography(t: Column) -> Column:
    t = stripped(t)
    return (count(t, ",") >= 4) & (t.rlike(r"(?-U)\b(19|20)\d{2}\b") | t.rlike(r"(?i)\b(arxiv|preprint|proceedings|conference|journal|transactions)\b"))


def is_contribution_list(t: Column) -> Column:
    low = F.lower(t)
    return (count(t, ",") >= 4) & F.exists(F.array(*[F.lit(x) for x in CONTRIBUTIONS]), lambda x: F.contains(low, x))


def is_front_title(t: Column) -> Column:
    n = count(t, ALNUM)
    return (n <= 12) & (words_like(t, TITLE) >= F.greatest(F.lit(3), F.floor(n * 0.45)))


def is_author_list(t: Column) -> Column:
    n = count(t, r"[\p{L}\p{N}.]+")
    names = words_like(t, NAME, r"[\p{L}\p{N}.]+")
    return (n >= 8) & (count(t, ",") >= 3) & (names >= 0.65 * n) & (words_like(t, PROSE, r"[\p{L}\p{N}.]+") <= 2)


def is_figure_label(t: Column) -> Column:
    return (count(t, MARKS) == 0) & (count(t, ALNUM) <= 8) & ((words_like(t, TITLE) >= 2) | (words_like(t, LABELS) >= 2))


def is_epigraph(t: Column) -> Column:
    t = stripped(t)
    return (count(t, ALNUM) <= 14) & t.rlike(r"^I\s+(am|have|was|will|shall|can|could|would|should)\b") & (words_like(t, ACADEMIC) == 0)


def is_attribution(t: Column) -> Column:
    n = count(t, r"[\p{L}\p{N}.]+")
    return n.between(3, 8) & (count(t, ",") >= 2) & (words_like(t, NAME, r"[\p{L}\p{N}.]+") >= n - 1)


def is_diagram_label(t: Column) -> Column:
    found = words_like(t, DIAGRAM)
    return (found >= 3) & (found >= 0.2 * count(t, ALNUM))


def is_action_label(t: Column) -> Column:
    prefix = F.lower(t).rlike(r"^(demonstration data|autonomous data|robot data|non-robot data|multimodal web data|egocentric human data)\b")
    return prefix | ((count(t, ALNUM) >= 10) & (words_like(t, ACTIONS) >= 3))


def is_paragraph(t: Column) -> Column:
    """Academic prose: enough words and lower case, none of the detectors above."""
    marks, words = count(t, MARKS), count(t, ALNUM)
    noise = is_reference(t) | is_bibliography(t) | is_contribution_list(t) | is_front_title(t) | is_author_list(t) | is_figure_label(t) | is_epigraph(t)
    label = (marks == 0) & (is_diagram_label(t) | is_action_label(t))
    return (words >= 4) & ~((count(t, ",") >= 3) & (marks == 0)) & (count(t, r"\p{Ll}") >= 6) & ~noise & ~label & ((marks > 0) | (words >= 6))


def is_translatable(t: Column) -> Column:
    plain = F.trim(t)
    good = count(plain, r"[\p{L}\p{N}\p{P}\p{Zs}]") >= 0.85 * F.greatest(F.lit(1), F.length(plain))
    return (plain != "") & ~plain.rlike("[□�]") & (count(plain, ALNUM) >= 4) & (count(plain, LETTER) >= 8) & good


def is_formula(t: Column) -> Column:
    """Short, with three operators or more, and one for every three letters or so."""
    signs, letters = count(t, MATH), count(t, LETTER)
    return (F.length(t) <= 120) & (signs >= 3) & (signs >= 0.35 * letters)


def spaced_heading(t: Column) -> Column:
    """A heading whose capitals stand apart, drawn together."""
    tight = F.regexp_replace(F.regexp_replace(F.trim(t), r"\s*-\s*", "-"), r"\s+", " ")
    return F.regexp_replace(tight, r"(?<![A-Za-z0-9_])([A-Z])\s+(?=[A-Z][A-Z-]*(?![A-Za-z0-9_]))", "$1")


def is_section_heading(t: Column) -> Column:
    plain = F.trim(t)
    return plain.rlike(SECTION_NAME) | plain.rlike(SECTION_NUMBERED) | plain.rlike(SECTION_LETTERED)


def line_type(t: Column) -> Column:
    plain = F.trim(t)
    section = plain.rlike(MAY_BE_SECTION) & let(spaced_heading(plain), is_section_heading)
    return F.when(plain.rlike(CAPTION), "caption").when(is_formula(plain), "formula").when(plain.rlike(CAPITALS) | section, "heading").otherwise("paragraph")


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


def _like(pattern: str, words: str = ALNUM) -> str:
    return f"len(list_filter(regexp_extract_all(t, '{words}'), lambda w: regexp_full_match(w, '{pattern}')))"


_NAMES = r"[\p{L}\p{N}.]+"
_STRIPPED = rf"regexp_replace(t, '^{SPACE_RE2}|{SPACE_RE2}$', '', 'g')"
#: The detectors as SQL over a column ``t``.
SQL = {
    "is_reference": rf"(regexp_matches({_STRIPPED}, '^\[\d+\]\s+') OR regexp_matches({_STRIPPED}, '^\d+\.\s+\p{{Lu}}[\p{{L}}.-]+,\s+\p{{Lu}}'))",
    "is_bibliography": rf"({_n(',')} >= 4 AND (regexp_matches(t, '\b(19|20)\d{{2}}\b') OR regexp_matches(t, '(?i)\b(arxiv|preprint|proceedings|conference|journal|transactions)\b')))",
    "is_contribution_list": f"({_n(',')} >= 4 AND len(list_filter([{', '.join(repr(x) for x in CONTRIBUTIONS)}], lambda x: contains(lower(t), x))) > 0)",
    "is_front_title": f"({_n(ALNUM)} <= 12 AND {_like(TITLE)} >= greatest(3, floor({_n(ALNUM)} * 0.45)))",
    "is_author_list": f"({_n(_NAMES)} >= 8 AND {_n(',')} >= 3 AND {_like(NAME, _NAMES)} >= 0.65 * {_n(_NAMES)} AND {_like(PROSE, _NAMES)} <= 2)",
    "is_figure_label": f"({_n(MARKS)} = 0 AND {_n(ALNUM)} <= 8 AND ({_like(TITLE)} >= 2 OR {_like(LABELS)} >= 2))",
    "is_epigraph": rf"({_n(ALNUM)} <= 14 AND regexp_matches({_STRIPPED}, '^I\s+(am|have|was|will|shall|can|could|would|should)\b') AND {_like(ACADEMIC)} = 0)",
    "is_attribution": f"({_n(_NAMES)} BETWEEN 3 AND 8 AND {_n(',')} >= 2 AND {_like(NAME, _NAMES)} >= {_n(_NAMES)} - 1)",
    "is_diagram_label": f"({_like(DIAGRAM)} >= 3 AND {_like(DIAGRAM)} >= 0.2 * {_n(ALNUM)})",
    "is_action_label": rf"(regexp_matches(lower(t), '^(demonstration data|autonomous data|robot data|non-robot data|multimodal web data|egocentric human data)\b') OR ({_n(ALNUM)} >= 10 AND {_like(ACTIONS)} >= 3))",
    "is_translatable": rf"(trim(t) <> '' AND NOT regexp_matches(t, '[□\x{{FFFD}}]') AND {_n(ALNUM)} >= 4 AND {_n(LETTER)} >= 8 AND len(regexp_extract_all(trim(t), '[\p{{L}}\p{{N}}\p{{P}}\p{{Zs}}]')) >= 0.85 * greatest(1, length(trim(t))))",
    "is_formula": f"(length(t) <= 120 AND {_n(MATH)} >= 3 AND {_n(MATH)} >= 0.35 * {_n(LETTER)})",
    "is_section_heading": rf"(regexp_matches(trim(t), '{SECTION_NAME}') OR regexp_matches(trim(t), '{SECTION_NUMBERED}') OR regexp_matches(trim(t), '{SECTION_LETTERED}'))",
}
_noise = " OR ".join(SQL[k] for k in ("is_reference", "is_bibliography", "is_contribution_list", "is_front_title", "is_author_list", "is_figure_label", "is_epigraph"))
SQL["is_paragraph"] = rf"({_n(ALNUM)} >= 4 AND NOT ({_n(',')} >= 3 AND {_n(MARKS)} = 0) AND {_n(chr(92) + 'p{Ll}')} >= 6 AND NOT ({_noise}) AND NOT ({_n(MARKS)} = 0 AND ({SQL['is_diagram_label']} OR {SQL['is_action_label']})) AND ({_n(MARKS)} > 0 OR {_n(ALNUM)} >= 6))"
DETECTORS = {k: globals()[k] for k in SQL}


# -- text of pages ---------------------------------------------------------------------

#: Dashes at a line's end, sections named at a paragraph's start.
DASH_END = r"[-\u00ad\u2010-\u2015]$"
INLINE_SECTION = r"(?i)^(abstract|introduction|conclusion|references)\s*[-\u2013\u2014]\s*(.+)$"


def extracted(text: Column) -> Column:
    """White space collapsed, and a number after a pi drawn together."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"([πΠ])\s+(\d)\s*\.\s*(\d)", "$1$2.$3"))


def joined_lines(lines: Column) -> Column:
    """The lines of a paragraph as one text; a dash at a line's end goes with the break after it."""

    def add(text: Column, line: Column) -> Column:
        bare = stripped(line)
        return F.when(text == "", bare).when(text.rlike(DASH_END), F.concat(F.regexp_replace(text, DASH_END, ""), bare)).otherwise(F.concat(text, F.lit(" "), bare))

    return extracted(F.aggregate(lines, F.lit(""), add))


def inline_section(text: Column) -> Column:
    """The section named at a paragraph's start ("Abstract - ..."), or null."""
    name = F.regexp_extract(text, INLINE_SECTION, 1)
    return F.when(name != "", F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 100))))


def inline_body(text: Column) -> Column:
    return stripped(F.regexp_extract(text, INLINE_SECTION, 2))


def ends_sentence(text: Column) -> Column:
    return stripped(text).rlike(r"[.!?。！？][)\"'\]]*$")


def is_included(kind: Column, text: Column) -> Column:
    """Whether a block of this kind is kept."""
    plain = stripped(text)
    heading = ~plain.rlike(r"(?i)^references$") & ~plain.rlike(r"^[A-Z]\.\s+Contributions$") & is_section_heading(plain)
    chosen = F.when(kind == "paragraph", is_paragraph(plain)).when(kind == "heading", heading).when(kind == "caption", plain.rlike(r"(?i)^((fig\.|figure|table)\s*\d+[:.])")).otherwise(True)
    return (plain != "") & chosen
