"""Column functions over program texts and token arrays."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.vocab import BASE, Vocabulary

# Words of C and C++ that are never identifiers to rename: keywords, and names of the standard library.
KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return "
    "short signed sizeof static struct switch typedef union unsigned void volatile while bool true false NULL nullptr class public private "
    "protected virtual template typename namespace using new delete this try catch throw const_cast dynamic_cast static_cast "
    "reinterpret_cast operator friend explicit mutable asm wchar_t typeid and or not xor bitand bitor compl and_eq or_eq xor_eq not_eq"
).split()
LIBRARY = (
    "printf scanf fprintf fscanf sprintf sscanf puts gets getchar putchar fgets fputs malloc calloc realloc free memset memcpy memmove memcmp "
    "strlen strcpy strncpy strcat strncat strcmp strncmp strstr strchr strrchr atoi atof atol strtol strtod abs fabs sqrt pow exp log log10 "
    "sin cos tan asin acos atan atan2 ceil floor round rand srand time exit abort assert fopen fclose fread fwrite fseek ftell rewind "
    "qsort bsearch isalpha isdigit isalnum isspace isupper islower toupper tolower main cin cout cerr endl string vector map set queue stack "
    "pair sort reverse max min swap push_back pop_back begin end size empty clear find insert erase front back top push pop first second "
    "make_pair lower_bound upper_bound next_permutation prev_permutation accumulate fill count unique nth_element partial_sort "
    "priority_queue deque list bitset algorithm iostream cstdio cstdlib cstring cmath climits cfloat cassert cctype ctime fstream sstream "
    "iomanip numeric functional iterator utility INT_MAX INT_MIN LONG_MAX LONG_MIN DBL_MAX DBL_MIN LLONG_MAX LLONG_MIN UINT_MAX SIZE_MAX "
    "std ios istream ostream getline to_string stoi stol stof stod include define ifdef ifndef endif pragma MAXN MOD INF EPS PI N M"
).split()
RESERVED = KEYWORDS + LIBRARY
# What is taken out of C code before identifiers are looked for, and what stands for it.
COMMENTS = ((r'"[^"\\]*(?:\\.[^"\\]*)*"', '""'), (r"'[^'\\]*(?:\\.[^'\\]*)*'", "''"), (r"//[^\n]*", ""), (r"(?s)/\*.*?\*/", ""), (r"#\s*[A-Za-z0-9_]+[^\n]*", ""))


def tokens(text: Column, vocab: Vocabulary = BASE) -> Column:
    return F.regexp_extract_all(text, F.lit(vocab.pattern), F.lit(0))


def token_ids(tok: Column, vocab: Vocabulary = BASE) -> Column:
    """Null for a token that isn't a keyword. Keywords of one character are found by their place in a text of all of them."""
    singles = [k for k in vocab.keywords if len(k) == 1]
    at = vocab.ids
    if [at[k] for k in singles] != list(range(len(vocab.keywords) - len(singles), len(vocab.keywords))):
        raise ValueError("keywords of one character come last")
    longer = F.create_map(*(F.lit(x) for k, i in at.items() if len(k) > 1 for x in (k, i)))
    place = lambda t: F.nullif(F.instr(F.lit("".join(singles)), t), F.lit(0)) + F.lit(len(vocab.keywords) - len(singles) - 1)
    return F.transform(tok, lambda t: F.when(F.length(t) == 1, place(t)).otherwise(F.try_element_at(longer, t)))


def tokens_of(ids: Column, vocab: Vocabulary = BASE) -> Column:
    words = F.array(*map(F.lit, vocab.keywords))
    return F.transform(ids, lambda i: F.get(words, i))


def is_covered(tok: Column, vocab: Vocabulary = BASE) -> Column:
    """0 if all tokens are keywords, else -1."""
    return F.when(F.exists(tok, lambda t: ~t.isin(*vocab.keywords)), -1).otherwise(0)


def boundaries(tok: Column, vocab: Vocabulary = BASE) -> Column:
    """0-based places of the boundary token, and the length."""
    places = F.filter(F.transform(tok, lambda t, i: F.when(t == vocab.boundary, i)), lambda i: i.isNotNull())
    return F.concat(places, F.array(F.size(tok)))


def boundaries_of(text: Column, vocab: Vocabulary = BASE) -> Column:
    """boundaries() of a text's tokens, which are cut once."""
    return F.get(F.transform(F.array(tokens(text, vocab)), lambda tok: boundaries(tok, vocab)), F.lit(0))


def two_back_spans(bounds: Column) -> Column:
    """Differences between each boundary and the one two before it."""
    n = F.size(bounds)
    later, earlier = F.slice(bounds, 3, F.greatest(n - 2, F.lit(0))), F.slice(bounds, 1, F.greatest(n - 2, F.lit(0)))
    return F.zip_with(later, earlier, lambda x, y: x - y)


def last_line(text: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n", -1), -1)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def indent(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("\t"), x)), "\n")


def outcome(generated: Column, reference: Column) -> Column:
    """hard: equal up to the end mark; soft: only the last lines are equal; fail."""
    clean = F.substring_index(generated, " \n\n", 1)
    return F.when(clean == reference, "hard").when(last_line(clean) == last_line(reference), "soft").otherwise("fail")


def base26(number: Column, length: int) -> Column:
    """The last length digits of a number to base 26, as letters."""
    digits = [F.char(F.lit(97) + F.pmod(F.floor(number / F.lit(26**k)), F.lit(26))) for k in range(length - 1, -1, -1)]
    return F.concat(*digits)


def without_comments(code: Column) -> Column:
    """C code without the contents of strings and characters, comments and preprocessor lines."""
    for pattern, to in COMMENTS:
        code = F.regexp_replace(code, pattern, to)
    return code


def identifiers(code: Column, reserved: list[str] = RESERVED) -> Column:
    """Sorted distinct identifiers of ASCII letters, digits and _, without reserved words and those that begin with __."""
    runs = F.regexp_extract_all(without_comments(code), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    distinct = F.array_distinct(F.filter(runs, lambda w: w.rlike("^[A-Za-z_]") & ~w.startswith("__")))
    return F.array_sort(F.array_except(distinct, F.array(*map(F.lit, reserved))))


def once(column: Column, make) -> Column:
    """make(column) as a generator of one row: the column is computed once, however often make uses it and filters are pushed down."""
    return F.explode(F.transform(F.array(column), make))


def fresh_names(names: Column, words: Column, tail: Column) -> Column:
    """var_<place>_<tail> for each of names; filled up with _ beyond the longest word that begins with var_ if the text has such a word
    already, so that no new name is that of another variable."""
    longest = F.coalesce(F.array_max(F.transform(F.filter(words, lambda w: w.startswith("var_")), F.length)), F.lit(0))
    name = lambda i: F.concat(F.lit("var_"), i.cast("string"), F.lit("_"), tail.cast("string"))
    return F.transform(names, lambda x, i: F.when(F.array_contains(words, name(i)), F.rpad(name(i), longest + 1, F.lit("_"))).otherwise(name(i)))


def rename(code: Column, names: Column) -> Column:
    """Replaces whole words by a map, all at once: word and other runs are mapped and put together again.

    Give names as a column that a select has made: an expression would be built anew for each word."""
    runs = F.regexp_extract_all(code, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    mapped = F.array_join(F.transform(runs, lambda w: F.coalesce(F.try_element_at(names, w), w)), "")
    return F.when(F.size(names) > 0, mapped).otherwise(code)


def u01(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of the parts: the same for any partitioning."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return u01_of(F.sha2(text, 256))


def hashed(*parts: Column | str | int) -> Column:
    """The whole hash that u01 begins with: an order by it has no ties but those of the parts."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def u01_of(digest: Column, k: int = 0) -> Column:
    """The k-th number (0 to 3) in [0, 1) of a hexadecimal SHA-256: 13 digits each."""
    return F.conv(F.substring(digest, 13 * k + 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def below(digest: Column, share: float, k: int = 0) -> Column:
    """Whether u01_of(digest, k) < share, by the digits as they are."""
    least = math.ceil(Fraction(share) * 16**13)
    return F.substring(digest, 13 * k + 1, 13) < f"{least:013x}" if least < 16**13 else F.lit(True)


def program_features(code: Column) -> Column:
    """line_count, if_count (blocks by depth, 0 to 10), max_depth, ops (+ and - between two operands, sorted) of a tab-indented program."""
    depth = lambda x: F.length(x) - F.length(F.ltrim(x, F.lit("\t")))
    block = lambda x: F.ltrim(x, F.lit("\t")).rlike("^(if|for) ")

    def of(lines):
        deep = F.transform(F.filter(lines, block), depth)
        return F.struct(
            F.size(lines).alias("line_count"),
            F.transform(F.sequence(F.lit(0), F.lit(10)), lambda d: F.size(F.filter(deep, lambda x: x == d))).alias("if_count"),
            F.array_max(F.transform(lines, depth)).alias("max_depth"),
            F.filter(F.array(F.lit("+"), F.lit("-")), lambda op: F.exists(lines, lambda x: F.contains(x, F.concat(F.lit(" "), op, F.lit(" "))))).alias("ops"),
        )

    return F.get(F.transform(F.array(F.split(code, "\n", -1)), of), F.lit(0))
