"""Column functions for cleaning, normalising and tokenising text. All are built-in expressions, none a Python UDF."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on: phrases, word lists, code signs and thresholds of the evaluated systems.
NOISE_PHRASES = (
    "Esta traducción fue hecha por IA guiada por humanos",
    "Podría tener errores al interpretar el significado original",
    "o sonar poco natural",
    "Puedes mejorar esta traducción",
    "ayudándonos a guiar mejor al LLM de IA",
    "Versión en inglés",
    "Copiar al portapapeles",
    "Editar esta página",
    "Ver código fuente",
)
STOPWORDS = (
    "para", "desde", "sobre", "entre", "como", "esta", "este", "estos", "estas", "crear", "utiliza", "utilizado", "selecciona",
    "respuesta", "correcta", "intenta", "responder", "antes", "revisar", "conceptos", "basicos", "comprender",
)
DIAGNOSIS_STOPWORDS = (
    "que", "de", "la", "el", "los", "las", "un", "una", "unos", "unas", "y", "o", "en", "del", "al", "se", "es", "son", "para", "por",
    "con", "como", "qué", "cual", "cuál", "sobre", "este", "esta", "estos", "estas", "su", "sus", "lo", "le", "les", "a",
)
CODE_SIGNS = ("def ", "class ", "import ", "from ", "return ", "SELECT ", "INSERT ", "UPDATE ", "DELETE ", "CREATE TABLE", "console.log(", "print(", "```", "{", "}", "[", "]")
NEUTRAL_TERMS = ("ademas", "mediante")
MIN_CLAIM, MAX_CLAIM = 8, 600
TITLE_KEYS = ("filename", "file_name", "source", "title")


def _unmarked(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _rewrites(form) -> tuple[str, str, dict[str, str]]:
    """Characters that a normal form turns into one other and those others (into none: last), and a map of those that it turns into several.

    Marks of their own and Hangul syllables, whose parts are no marks, are left out.
    """
    changed = {chr(c): form(chr(c)) for c in (*range(0x80, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)) if not unicodedata.combining(chr(c))}
    changed = {c: x for c, x in changed.items() if x != c}
    one = {c: x for c, x in changed.items() if len(x) == 1} | {c: x for c, x in changed.items() if not x}
    return "".join(one), "".join(one.values()), {c: x for c, x in changed.items() if len(x) > 1}


_MARKED, _BASE, _SPREAD = _rewrites(_unmarked)
_COMPATIBLE, _PLAIN_FORM, _SEVERAL = _rewrites(lambda c: unicodedata.normalize("NFKC", c))
#: A letter with one mark after it, and the one character of both.
_COMPOSED = {
    "".join(chr(int(x, 16)) for x in parts): chr(c)
    for c in range(0xC0, 0x3100)
    if len(parts := unicodedata.decomposition(chr(c)).split()) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(c)) == chr(c)
}


def let(value: Column, body) -> Column:
    """The body with the value bound to a variable, so that lambdas inside it don't compute the value anew each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that are computed once, however many later expressions and filters use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def _by_parts(c: Column, pattern: str, table: dict[str, str]) -> Column:
    """The text with each of the parts that the pattern finds replaced by the table; only for texts that have such parts.

    What lies between two of them is one part; parts no longer than the longest of the table are looked for in it.
    """
    known = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    longest = max(map(len, table))
    told = lambda x: F.when(F.length(x) <= longest, F.coalesce(F.try_element_at(known, x), x)).otherwise(x)
    # a part has a sign beyond ASCII at its start or next to it, so signs between two of ASCII are passed without the pattern
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)(?:{pattern})|(?:[\x00-\x7F](?=[\x00-\x7F]|\z)|(?!{pattern}).)++"), F.lit(0)), told), "")


def _one_of(characters) -> str:
    """A class of characters, by their runs of code points: a tree, as a class tries its runs one by one."""
    points = sorted(map(ord, characters))
    runs = list(zip([p for p, before in zip(points, [-2, *points]) if p != before + 1], [p for p, after in zip(points, [*points[1:], -2]) if after != p + 1]))
    span = lambda p, q: f"\\x{{{p:X}}}-\\x{{{q:X}}}"

    def tree(some) -> str:
        if len(some) <= 4:
            return "".join(span(*r) for r in some)
        half = len(some) // 2
        return "".join(f"[{span(part[0][0], part[-1][1])}&&[{tree(part)}]]" for part in (some[:half], some[half:]))

    return f"[{tree(runs)}]"


def _rewritten(c: Column, one: str, others: str, several: dict[str, str], then) -> Column:
    """Characters rewritten one by one; texts of Latin letters alone, as most are, by a table of those."""
    small = [(x, y) for x, y in zip_longest(one, others) if ord(x) < _LATIN]
    small.sort(key=lambda xy: xy[1] is None)
    latin = f"[[^\\x00-\\x7F]&&[^{_one_of(set(map(chr, range(_LATIN))) - set(several))}\\x{{2012}}-\\x{{2015}}\\x{{2018}}-\\x{{201F}}]]"

    def all_of(x: Column) -> Column:
        parts = F.when(x.rlike(_one_of(several)), _by_parts(x, _one_of(several), several)).otherwise(x)
        return then(F.translate(parts, one, others))

    fast = lambda x: F.translate(x, "".join(k for k, _ in small), "".join(v for _, v in small if v is not None))
    return let(c, lambda x: F.when(_ascii(x), x).when(~x.rlike(latin), fast(x)).otherwise(all_of(x)))


#: Code points of the Latin blocks, which have no marks of their own.
_LATIN = 0x250


def strip_accents(c: Column) -> Column:
    """Compatible characters decomposed, without marks. Hangul syllables stay as they are."""
    return _rewritten(c, _MARKED, _BASE, _SPREAD, lambda x: F.regexp_replace(x, r"\p{M}+", ""))


def compose(c: Column) -> Column:
    """NFKC: compatible characters replaced, and letters joined with the marks that follow, up to three in their order."""
    pairs = _one_of({d[0] for d in _COMPOSED}) + _one_of({d[1] for d in _COMPOSED})

    def join(x: Column) -> Column:
        for _ in range(3):
            x = let(x, lambda y: F.when(y.rlike(r"\p{M}"), _by_parts(y, pairs, _COMPOSED)).otherwise(y))
        return x

    return _rewritten(c, _COMPATIBLE, _PLAIN_FORM, _SEVERAL, join)


def strip(c: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    # single spaces stay as they are, and only spaces are left at the ends
    return F.trim(F.regexp_replace(c, r"\s{2,}|[^\S ]", " "))


def clean_text(c: Column) -> Column:
    """B1: composed compatible characters and line feeds; white space stays, null is empty."""
    return normalize_newlines(compose(F.coalesce(c, F.lit(""))))


def normalize_newlines(c: Column) -> Column:
    """Line feeds as line ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")


def clean_whitespace(c: Column) -> Column:
    """B2."""
    return strip(F.regexp_replace(F.regexp_replace(normalize_newlines(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def remove_known_noise(c: Column, phrases=NOISE_PHRASES) -> Column:
    """Without lines that hold one of the phrases, unless they begin a fence or a heading."""
    def keep(line: Column) -> Column:
        bare = strip(line)
        noisy = reduce(Column.__or__, [F.contains(F.lower(bare), F.lit(p.lower())) for p in phrases])
        return bare.startswith("```") | bare.startswith("#") | ~noisy

    lines = F.transform(F.split(normalize_newlines(c), "\n"), lambda x: F.when(strip(x) == "", "").otherwise(x))
    return strip(F.regexp_replace(F.array_join(F.filter(lines, keep), "\n"), r"\n{3,}", "\n\n"))


# Fixed values of B5: the plain text of the evaluated corpus, and so every figure on it, is defined by these patterns and
# their order, as later ones see what earlier ones leave.
_PLAIN = (
    (r"```[a-zA-Z0-9_+-]*\n", ""),
    (r"```", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s+", ""),
    (r"(?m)^\s*>\s?", ""),
    (r"(?m)^\s*[-*+]\s+", "- "),
    (r"(?m)^\s*(\d+)\.\s+", "$1. "),
    (r"\*\*(.*?)\*\*", "$1"),
    (r"__(.*?)__", "$1"),
    (r"(?<!\*)\*(?!\*)(.*?)\*(?!\*)", "$1"),
    (r"(?<!_)_(?!_)(.*?)_(?!_)", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^\s*([-*_])(?:\s*\1){2,}\s*$", ""),
    (r"\n{3,}", "\n\n"),
)


def markdown_to_plain_text(c: Column) -> Column:
    """B5."""
    return F.concat(strip(reduce(lambda t, rule: F.regexp_replace(t, *rule), _PLAIN, normalize_newlines(c))), F.lit("\n"))


def clean_markdown_line(c: Column) -> Column:
    """One line without its heading, quote, bullet, number and check-box marks."""
    rules = (r"^#{1,6}\s+", r"^>\s*", r"^[-*+]\s+", r"^\d+[.)]\s+", r"^\[[ xX]\]\s+")
    return strip(reduce(lambda t, rule: F.regexp_replace(t, rule, ""), rules, strip(c)))


def is_code(c: Column) -> Column:
    """B8."""
    return strip(c).rlike("^(?:" + "|".join(re.escape(s) for s in CODE_SIGNS) + ")")


def is_noise(c: Column) -> Column:
    """B9."""
    return strip(c).rlike(r"^(?:$|[-=_#*`~\s]+$|https?://|www\.)")


def valid_length(c: Column, least: int = MIN_CLAIM, most: int = MAX_CLAIM) -> Column:
    """B10."""
    return F.length(strip(c)).between(least, most)


def split_sentences(c: Column) -> Column:
    """A sentence ends before an upper-case letter, a digit or an inverted mark."""
    return F.filter(F.split(squeeze(c), r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡0-9])"), lambda x: x != "")


def split_claims(c: Column) -> Column:
    """A sentence ends after any of the marks."""
    return F.filter(F.split(squeeze(c), r"(?<=[.!?])\s+"), lambda x: x != "")


def dedup_key(c: Column) -> Column:
    """Lower case, no marks, single spaces, no punctuation."""
    return strip(F.regexp_replace(squeeze(strip_accents(F.lower(c))), r"[^\p{L}\p{N}_\s]", ""))


def overlap_key(c: Column) -> Column:
    """Composed compatible characters, lower case, single spaces, none before punctuation; the rest stays."""
    return F.regexp_replace(squeeze(F.lower(compose(c))), r"\s+([,.;:!?])", "$1")


def retrieval_key(c: Column) -> Column:
    """Lower case, no marks, single spaces; punctuation stays."""
    return squeeze(strip_accents(F.lower(c)))


def retrieval_keys(items: Column) -> Column:
    """B15 of all items of a list: one pass over all of them, unless one is null or has the sign that stands between them."""
    joined = F.regexp_replace(strip(F.regexp_replace(strip_accents(F.lower(F.array_join(items, _BETWEEN))), r"\s+", " ")), f" ?{_BETWEEN} ?", _BETWEEN)
    each = let(F.split(joined, _BETWEEN), lambda x: F.when(F.size(x) == F.size(items), x).otherwise(F.transform(items, retrieval_key)))
    return F.when(F.size(items) == 0, items).when(F.exists(items, lambda x: x.isNull()), F.transform(items, retrieval_key)).otherwise(each)


def diagnosis_key(c: Column) -> Column:
    """B16."""
    return strip(F.regexp_replace(strip_accents(F.lower(c)), r"[^a-z0-9_./@+-]+", " "))


def diagnosis_tokens(c: Column) -> Column:
    """The distinct tokens of more than two characters that are no stop words."""
    return F.filter(F.array_distinct(F.split(diagnosis_key(c), " ")), lambda x: (F.length(x) > 2) & ~x.isin(*DIAGNOSIS_STOPWORDS))


def words(c: Column) -> Column:
    """Lower-cased words, marks kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def spaced_words(c: Column) -> Column:
    """B18 as one text: the words with a space between them, and where the text begins or ends with other signs."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")


def plain_words(c: Column) -> Column:
    """Words without marks."""
    return F.regexp_extract_all(retrieval_key(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def significant_words(c: Column) -> Column:
    """Words of more than three characters that are no stop words, with repetitions."""
    return F.filter(plain_words(c), lambda x: (F.length(x) > 3) & ~x.isin(*STOPWORDS))


def singular(token: Column) -> Column:
    """A token without marks and other signs, and without its plural ending."""
    bare = F.regexp_replace(strip_accents(F.lower(strip(token))), r"[^a-z0-9_áéíóúñü]+", "")
    # an ending of a token that keeps at least four characters of it
    return F.regexp_replace(bare, r"(?s)^(.{4,})es$|^(.{4,})s$", "$1$2")


#: Stands between the words of a list that is rewritten as one text; no word has it.
_BETWEEN = "\x1f"


def _over_words(words: Column, rewrite) -> Column:
    """A list of words after a rewriting that keeps their borders: one pass over all of them, not one a word."""
    def whole(w: Column) -> Column:
        joined = F.array_join(F.filter(w, lambda x: x.isNotNull()), _BETWEEN)
        return F.when(F.size(w) > 0, F.split(rewrite(joined), _BETWEEN)).when(w.isNotNull(), F.array().cast("array<string>"))

    return let(words, whole)


def singular_words(words: Column) -> Column:
    """B23 of all words of a list."""
    bare = lambda c: F.regexp_replace(strip_accents(F.lower(c)), rf"[^a-z0-9_áéíóúñü{_BETWEEN}]+", "")
    whole = rf"(?<![^{_BETWEEN}])([^{_BETWEEN}]{{4,}})"
    return _over_words(words, lambda c: F.regexp_replace(bare(c), rf"{whole}es(?![^{_BETWEEN}])|{whole}s(?![^{_BETWEEN}])", "$1$2"))


#: Endings in their order, with the least length of the token; the first that fits is cut off.
STEM_RULES = (
    (("adas", "ados", "idos", "idas"), 8), (("ada", "ado", "ida", "ido"), 7), (("an", "en"), 6), (("amos", "emos", "imos"), 8), (("ar", "er", "ir"), 6), (("es",), 7), (("s",), 6), (("a", "e"), 6),
)


def _cut_endings(c: Column) -> Column:
    """Words in one text without their endings; the alternatives are tried in the order of the rules."""
    word = rf"[^{_BETWEEN}]"
    rules = "|".join(f"({word}{{{least - len(endings[0])},}})(?:{'|'.join(endings)})" for endings, least in STEM_RULES)
    kept = "".join(f"${i}" for i in range(1, len(STEM_RULES) + 1))
    return F.regexp_replace(c, rf"(?<!{word})(?:{rules})(?!{word})", kept)


def stem(token: Column) -> Column:
    """B24."""
    return _cut_endings(strip_accents(F.lower(token)))


def normalize_terms(terms: Column) -> Column:
    """Stems of the terms that are not neutral, each once, in order of first occurrence."""
    neutral = F.array(*map(F.lit, NEUTRAL_TERMS))
    plain = _over_words(F.array_distinct(terms), lambda c: strip_accents(F.lower(c)))
    kept = F.filter(plain, lambda x: ~F.array_contains(neutral, x))
    return F.array_distinct(F.filter(_over_words(kept, _cut_endings), lambda x: x != ""))


def distinct_ignoring_case(items: Column) -> Column:
    """Squeezed items without empty ones, each once whatever its case, in the first spelling."""
    tidy = F.filter(F.transform(items, squeeze), lambda x: x != "")
    return F.aggregate(tidy, F.expr("cast(array() as array<string>)"), lambda s, x: F.when(F.exists(s, lambda y: F.lower(y) == F.lower(x)), s).otherwise(F.array_append(s, x)))


def shorten(c: Column, most: int = 300) -> Column:
    """B27."""
    t = squeeze(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def content_sha256(c: Column) -> Column:
    """B28, I2."""
    return F.sha2(c, 256)


def sanitize_filename(c: Column) -> Column:
    """B29."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", ""), r"[^/]*$", 0)
    safe = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(safe == "", "archivo").otherwise(safe)


def title_from_metadata(metadata: Column) -> Column:
    """Base name of the first key of the metadata map that is not empty."""
    first = F.coalesce(*[F.nullif(strip(metadata[k]), F.lit("")) for k in TITLE_KEYS])
    return F.regexp_extract(first, r"[^/\\]+$", 0)


def id_list(c: Column) -> Column:
    """The ids of a list with semicolons; null is empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def id_list_or_literal(c: Column) -> Column:
    """Also of a bracketed list with quoted items."""
    inner = F.filter(F.transform(F.split(F.regexp_replace(c, r"^\s*\[|\]\s*$", ""), ","), lambda x: F.regexp_replace(strip(x), r"^['\"]|['\"]$", "")), lambda x: x != "")
    return F.when(c.rlike(r"^\s*\[.*\]\s*$"), inner).otherwise(id_list(c))


def is_fallback_query(query: Column, pattern: str) -> Column:
    """B33."""
    return F.contains(F.lower(query), F.lit(pattern.lower()))


def as_bool(c: Column) -> Column:
    """B34."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 1 if both are empty."""
    share = lambda z: F.when(z.n == 0, 1.0).otherwise(F.size(F.array_intersect(z.a, z.b)) / z.n)
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: let(F.struct(x.a.alias("a"), x.b.alias("b"), F.size(F.array_union(x.a, x.b)).alias("n")), share))
