"""Column functions over text: identifier tokens, search tokens, lines, digests and predicates.

Everything is a Spark SQL expression, so it stays inside the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that join an identifier, and where one breaks into components.
BETWEEN_WORDS = r"[^\p{L}\p{N}_$\-/.]+"
ENDS = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
COMPONENTS = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[^\p{L}\p{N}]+"


def _folds() -> tuple[str, str]:
    """Latin letters with a mark, and the letter each one folds to: by canonical decomposition."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(a, b) for a, b in pairs if a != b and a.islower() or a != b and a.isupper()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def _capitals() -> tuple[str, str]:
    """Letters whose capital is several letters, or new in Unicode 16, and the one letter that stands for each in SQL."""
    wide = [c for c in map(chr, range(0xDF, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1]
    own = [c.title() if len(c.title()) == 1 else c for c in wide]
    new = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
    return "".join(wide) + new, "".join(own).replace("ß", "ẞ") + new


CAPITAL_FROM, CAPITAL_TO = _capitals()
# Few ranges that hold them all, as a look at every place of a text is to be short; the rest of a range is told apart letter by letter.
_NEAR_CAPITALS = "[\u00df\u0149\u01f0\u019b\u0264\u0390-\u0587\u1c8a\u1e96-\u1ffc\ua7cd\ua7db\ufb00-\ufb17\U00010d70-\U00010d86]"


def raw_words(text: Column) -> Column:
    """The identifier-like words of a text, outer signs trimmed, none empty."""
    trimmed = F.transform(F.split(text, BETWEEN_WORDS), lambda w: F.regexp_replace(w, ENDS, ""))
    return F.filter(trimmed, lambda w: w != "")


def word_tokens(word: Column) -> Column:
    """A word in lower case, then its distinct components in order, without itself."""
    whole = F.lower(word)
    parts = F.transform(F.split(word, COMPONENTS), lambda p: F.lower(p))
    parts = F.array_sort(F.array_distinct(F.filter(parts, lambda p: (p != "") & (p != whole))))
    return F.concat(F.array(whole), parts)


def tokens(text: Column) -> Column:
    """All tokens of a text in order."""
    return F.flatten(F.transform(raw_words(text), word_tokens))


def searchable(text: Column) -> Column:
    """The tokens as one string."""
    return F.array_join(tokens(text), " ")


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def upper_by_letter(text: Column) -> Column:
    """Upper case letter by letter as DuckDB has it: every letter becomes one letter, so ``ß`` is ``ẞ`` and not ``SS``."""
    alone = F.split(text, f"(?<={_NEAR_CAPITALS})|(?={_NEAR_CAPITALS})")
    special = lambda x: (F.char_length(x) == 1) & F.contains(F.lit(CAPITAL_FROM), x)
    return F.array_join(F.transform(alone, lambda x: F.when(special(x), F.translate(x, CAPITAL_FROM, CAPITAL_TO)).otherwise(F.upper(x))), "")


def search_tokens(text: Column, underscore: bool = True) -> Column:
    """Second-stage tokens: folded runs of letters and digits; ``_`` belongs to a token unless told otherwise."""
    between = r"[^\p{L}\p{N}_]+" if underscore else r"[^\p{L}\p{N}]+"
    return F.filter(F.split(fold(text), between), lambda t: t != "")


def lines(text: Column) -> Column:
    """Lines ended by LF or CRLF; a last line end opens no further line; an empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def retained_lines(content: Column) -> Column:
    """Line ends, and one more for a last line without one."""
    ends = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(content == "", 0).otherwise(ends + F.when(F.right(content, F.lit(1)) == "\n", 0).otherwise(1)).cast("long")


def parser_for(path: Column) -> Column:
    """The parser that a path's extension asks for, by exact case."""
    extension = F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1)
    return (
        F.when(extension.isin("ts", "mts", "cts", "js", "mjs", "cjs"), "typescript-v1")
        .when(extension.isin("tsx", "jsx"), "tsx-v1")
        .otherwise("lines-v1")
    )


def blob_id(content: Column, algorithm: str = "sha1") -> Column:
    """Object id of bytes under a ``blob <length> NUL`` header."""
    framed = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content)
    return F.sha1(framed) if algorithm == "sha1" else F.sha2(framed, 256)


def coin(seed: Column) -> Column:
    """A fair, repeatable 0 or 1: the last bit of the first byte of a SHA-256."""
    return (F.conv(F.substring(F.sha2(seed, 256), 1, 2), 16, 10).cast("int") % 2).cast("int")


def contains_count(line: Column, terms: Column) -> Column:
    """How many of the terms a line contains, case aside."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(line), t)))


def safe_path(path: Column) -> Column:
    """A relative path without backslash, control signs or empty, dot and repository components."""
    bad = r"^/|\\|[\x00-\x1F\x7F]|(^|/)(\.|\.\.|\.git)?(/|$)"
    return path.isNotNull() & (path != "") & ~path.rlike(bad)


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: ``**`` crosses directories, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            if c == "[" and (end := glob.find("]", i + 2)) > 0:
                inside = glob[i + 1 : end]
                out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside).replace("\\", "\\\\") + "]", end + 1
                continue
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c
            i += 1
    return f"^{out}$"


def printable(text: Column) -> Column:
    """Control and direction-override signs other than line ends as ``\\u{hex}``."""
    signs = [*map(chr, (*range(0, 10), *range(11, 32), *range(127, 160))), *"‪‫‬‭‮⁦⁧⁨⁩"]
    for s in signs:
        text = F.replace(text, F.lit(s), F.lit(f"\\u{{{ord(s):x}}}"))
    return text


def null_poisoning_sum(x: Column) -> Column:
    """A sum that is null unless there is a row and every value is known."""
    return F.when((F.count("*") > 0) & (F.count(x) == F.count("*")), F.sum(x))
