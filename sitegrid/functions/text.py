"""Text: normalised names, search scores, numbers as published, links, sentences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what is left of them.
ACCENTED, PLAIN = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūçñýÿ", "aaaaaaaeeeeeiiiiioooooouuuuucnyy"


def plain(text: Column) -> Column:
    """Lower case without accents on Latin letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def admin_name(name: Column, prefixes: Sequence[str], tokens: Mapping[str, str] | None = None, aliases: Mapping[str, str] | None = None) -> Column:
    """An administrative name for comparison: plain letters and digits with single blanks, without the first of the
    prefixes it starts with, tokens and whole names replaced by their aliases."""
    text = F.trim(F.regexp_replace(plain(name), "[^a-z0-9]+", " "))
    cut = text
    for p in reversed(list(prefixes)):
        cut = F.when(text.startswith(p + " "), F.substring(text, F.lit(len(p) + 2), F.length(text))).otherwise(cut)
    if tokens:
        table = F.create_map(*[F.lit(x) for pair in tokens.items() for x in pair])
        cut = F.array_join(F.transform(F.split(cut, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    for source, target in (aliases or {}).items():
        cut = F.when(cut == source, F.lit(target)).otherwise(cut)
    return cut


def letters_key(text: Column) -> Column:
    """Only letters and digits, upper case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def has_all_tokens(text: Column, query: str) -> Column:
    """Whether the text holds every word of the query, in any order and case; an empty query holds."""
    out = F.lit(True)
    for token in query.lower().split():
        out = out & F.coalesce(F.lower(text).contains(token), F.lit(False))
    return out


def match_score(text: Column, query: str) -> Column:
    """100 for equal, 80 for a beginning, 60 for the beginning of a word, 30 for a part, else 0 (also for null)."""
    # fixed values: these four scores
    t, q = F.lower(F.trim(text)), query.lower().strip()
    return F.coalesce(F.when(t == q, 100).when(t.startswith(q), 80).when(F.concat(F.lit(" "), t).contains(" " + q), 60).when(t.contains(q), 30), F.lit(0))


def published_number(value: Column, digits: int = 0, suffix: str = "") -> Column:
    """A number as printed: halves rounded up (away from 0), ``.`` between thousands, ``,`` before decimals."""
    exact = F.round(value.cast("decimal(38,10)"), digits)
    return F.concat(F.translate(F.format_number(exact, digits), ",.", ".,"), F.lit(suffix))


#: Fixed value: what is printed for a distance that isn't known.
BEYOND = "> 5 km"


def distance_label(metres: Column, beyond: str = BEYOND) -> Column:
    """Metres below 1 km, kilometres with one decimal above; null means nothing was found within the search.

    Kilometres are rounded by their exact binary value, as SQL prints them, halves to the even digit: format_string alone
    rounds 289.45, which is a little less than that, up. Each term below is exact.
    """
    km = metres.cast("double") / 1000
    whole = F.floor(km).cast("double")
    rest = km - whole
    tenths = F.floor(rest * 10).cast("double")
    half = (2 * tenths + 1) / 4 - 4 * rest  # rest is above the middle of two tenths if it is above this
    up = (rest > half) | ((rest == half) & (tenths % 2 == 1))
    rounded = (whole * 10 + tenths + up.cast("double")) / 10
    return F.when(metres.isNull(), F.lit(beyond)).when(metres < 1000, F.format_string("%.0f m", metres.cast("double"))).otherwise(F.format_string("%.1f km", rounded))


def links(html: Column) -> Column:
    """The targets of all ``href`` and ``src`` attributes, as an array."""
    return F.regexp_extract_all(html, F.lit("(?:href|src)=\"([^\"]*)\""), F.lit(1))


def strip_tags(html: Column) -> Column:
    """The text of a page with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "\\s+", " "))


def is_external(url: Column) -> Column:
    return url.rlike("^([a-z][a-z0-9+.-]*:|//)")


def resolved(base: Column, url: Column) -> Column:
    """The path a relative link of a page leads to: without query and fragment, with ``.`` and ``..`` taken up.

    An empty path is the page itself; a path that ends in ``/`` leads to its ``index.html``; ``..`` above the root stays there.
    """
    path = F.regexp_replace(url, "[?#].*$", "")
    folder = F.regexp_replace(base, "[^/]*$", "")
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    parts = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when((p == ".") | (p == ""), done).otherwise(F.concat(done, F.array(p))),
    )
    found = F.concat(F.array_join(parts, "/"), F.when(joined.endswith("/"), F.when(F.size(parts) > 0, "/index.html").otherwise("index.html")).otherwise(""))
    return F.when(path == "", base).otherwise(found)


def sentences(text: Column) -> Column:
    """Sentences of a text: parts that end with ``.``, ``!`` or ``?`` before a blank or the end, as an array."""
    marked = F.regexp_replace(F.regexp_replace(text, "\\s+", " "), "([.!?]) ", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_with(text: Column, mark: str) -> Column:
    """The first sentence that holds the mark, or null."""
    return F.try_element_at(F.filter(sentences(text), lambda s: s.contains(mark)), F.lit(1))


def sentence_at(text: Column, offset: int) -> Column:
    """The sentence that holds the character at ``offset`` (from 0) of the text with single blanks; null beyond its end."""
    parts = sentences(text)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))
    step = lambda done, s: F.struct((done["at"] + F.length(s) + 1).alias("at"), F.when((done["at"] <= offset) & (done["at"] + F.length(s) + 1 > offset), s).otherwise(done["found"]).alias("found"))
    return F.aggregate(parts, start, step)["found"]


#: A comment of a script, or a literal in one of the three kinds of quotes, whichever begins first.
_LITERAL = r"""/\*[\s\S]*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`"""


def string_literals(script: Column) -> Column:
    """The string literals of a script with their quotes, in order, as an array; quotes in comments begin none."""
    return F.filter(F.regexp_extract_all(script, F.lit(_LITERAL), F.lit(0)), lambda m: ~m.startswith("/"))
