"""Licence plates as column functions: cleaning, masks, normalisation, weighted distance, matches.

All are Catalyst expressions, evaluated in the JVM. Null gives null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OLD, NEW = "LLLDDDD", "LLLDLDD"
#: How a reader confuses characters. Letters for digits, and digits for letters.
TO_LETTER = ("01245678", "OIZASGZB")
TO_DIGIT = ("OQDUILTJZASGBE", "00001111245688")
#: Pairs, either way round, whose exchange costs 35 hundredths instead of 100.
CONFUSED = "0O 1I 1L IT 2Z 7Z 4A 5S 6G 8B BE 0D DO"
BOTH_WAYS = " ".join(x + " " + x[::-1] for x in CONFUSED.split())
_CONFUSED = BOTH_WAYS
#: Characters that confusions join, directly or by others, by one of them each.
KINDS = ("ODILTZ7ASGBE", "001112245688")
VALID = r"^[A-Z]{3}[0-9][A-Z0-9][0-9]{2}\z"
UNREAD, UNREAD_COST = "Nao foi possivel identificar os caracteres", 999.0


def bound(value: Column, of) -> Column:
    """of(value) with value evaluated once."""
    return F.transform(F.array(value), of)[0]


def clean(text: Column) -> Column:
    """Upper case, only A-Z and 0-9; a motorcycle plate read lower line first is put in order."""
    return bound(F.regexp_replace(F.upper(text), "[^A-Z0-9]", ""), reorder)


def reorder(text: Column) -> Column:
    """1234ABC and 1D23ABC become ABC1234 and ABC1D23; anything else stays."""
    turned = text.rlike(r"^([0-9]{4}|[0-9][A-Z][0-9]{2})[A-Z]{3}\z")
    return F.when(turned, F.concat(F.substring(text, 5, 3), F.substring(text, 1, 4))).otherwise(text)


def is_valid(text: Column) -> Column:
    """Whether a text is a plate of the old or new form, whole."""
    return text.rlike(VALID)


def mask_of(plate: Column) -> Column:
    """The form of a plate of seven characters (what else it has is dropped); null for other lengths."""
    bare = F.regexp_replace(F.upper(plate), "[^A-Z0-9]", "")
    return bound(bare, lambda t: F.when(F.length(t) == 7, F.when(F.substring(t, 5, 1).rlike("[A-Z]"), NEW).otherwise(OLD)))


def fit_mask(text: Column, mask: Column) -> Column:
    """text with each character that the mask's place cannot have replaced by the one it is taken for."""
    letter = lambda p, n: F.translate(F.substring(text, p, n), *TO_LETTER)
    digit = lambda p, n: F.translate(F.substring(text, p, n), *TO_DIGIT)
    return F.concat(letter(1, 3), digit(4, 1), F.when(mask == NEW, letter(5, 1)).otherwise(digit(5, 1)), digit(6, 2))


def normalize(text: Column, mask: Column | None = None) -> Column:
    """The plate in a reading: itself if valid, else the rightmost window of seven characters that a mask makes valid.

    The old form is tried before the new one unless a mask is given. With no such window the first seven
    characters remain; an empty reading stays empty.
    """
    mask = F.lit(None).cast("string") if mask is None else mask
    made = lambda w, m: bound(fit_mask(w, m), lambda p: F.when(is_valid(p), p))
    best = lambda w: F.coalesce(made(w, F.coalesce(mask, F.lit(OLD))), F.when(mask.isNull(), made(w, F.lit(NEW))))

    def of(t: Column) -> Column:
        starts = F.sequence(F.greatest(F.length(t) - 6, F.lit(1)), F.lit(1))  # right to left
        found = F.filter(F.transform(starts, lambda s: best(F.substring(t, s, F.lit(7)))), lambda x: x.isNotNull())
        return F.when(is_valid(t) | (t == ""), t).when(F.length(t) >= 7, F.coalesce(F.get(found, F.lit(0)), F.substring(t, 1, 7))).otherwise(t)

    return bound(clean(text), of)


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _table(a: Column, b: Column, first: Column, cell) -> Column:
    """The last cell of a table over the letters of a and b; cell(above, left, diagonal, x, y) makes each from three."""

    def over(x: Column, y: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(y))

        def row(above: Column, c: Column) -> Column:
            start = F.array(F.get(above, F.lit(0)) + first)
            step = lambda left, j: F.array_append(left, cell(F.get(above, j), F.get(left, j - 1), F.get(above, j - 1), c, F.get(y, j - 1)))
            return F.aggregate(places, start, step)

        begin = F.transform(F.sequence(F.lit(0), F.size(y)), lambda j: j * first)
        return F.aggregate(x, begin, row, lambda last: F.get(last, F.size(y)))

    return bound(F.struct(_letters(a).alias("a"), _letters(b).alias("b")), lambda s: over(s["a"], s["b"]))


def distance(expected: Column, read: Column) -> Column:
    """Edit distance of two plates, cleaned: 1 for an insertion, deletion or exchange, 0.35 for an exchange of confused characters.

    Costs are whole hundredths inside. An empty or null side gives 999. Were exchanges within a kind free, it would be
    no more, and at full cost no less; where these two edit distances are equal they are the result, and no table is filled.
    """
    hundred = F.lit(100)
    kinds = lambda x: F.translate(x, *KINDS)

    def cost(x: Column, y: Column) -> Column:
        return F.when(x == y, F.lit(0)).when(F.instr(F.lit(_CONFUSED), F.concat(x, y)) > 0, F.lit(35)).otherwise(hundred)

    def cell(above, left, diagonal, x, y):
        return F.least(above + hundred, left + hundred, diagonal + cost(x, y))

    def in_place(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(_letters(a), _letters(b), cost), F.lit(0), lambda n, x: n + x)

    def of(s: Column) -> Column:
        a, b = s["a"], s["b"]
        # of equal lengths, a way that inserts also deletes and costs 200 or more: exchanges up to that are the least
        by_exchange = F.when(F.length(a) == F.length(b), bound(in_place(a, b), lambda n: F.when(n <= 200, n)))
        # one begins or ends with the other: what is left is inserted, and no way inserts fewer
        partial = a.startswith(b) | a.endswith(b) | b.startswith(a) | b.endswith(a)
        inserted = F.abs(F.length(a) - F.length(b)).cast("double")
        settled = bound(F.levenshtein(a, b), lambda n: F.when(F.levenshtein(kinds(a), kinds(b)) == n, n.cast("double")))
        weighed = F.coalesce(by_exchange, _table(a, b, hundred, cell)) / F.lit(100.0)
        return F.when((a == "") | (b == ""), F.lit(UNREAD_COST)).when(a == b, F.lit(0.0)).when(partial, inserted).otherwise(F.coalesce(settled, weighed))

    return bound(F.struct(F.coalesce(clean(expected), F.lit("")).alias("a"), F.coalesce(clean(read), F.lit("")).alias("b")), of)


def common_subsequence(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence."""
    cell = lambda above, left, diagonal, x, y: F.when(x == y, diagonal + 1).otherwise(F.greatest(above, left))
    of = lambda s: F.when((s["a"] == "") | (s["b"] == ""), F.lit(0)).otherwise(_table(s["a"], s["b"], F.lit(0), cell))
    return F.when(a.isNotNull() & b.isNotNull(), bound(F.struct(a.alias("a"), b.alias("b")), of))


def same_places(a: Column, b: Column) -> Column:
    """How many places hold the same character."""
    return F.size(F.filter(F.zip_with(_letters(a), _letters(b), lambda x, y: x == y), lambda same: same))


def shared_letters(a: Column, b: Column) -> Column:
    """The size of the two texts' common multiset of characters."""

    def of(s: Column) -> Column:
        times = lambda letters, x: F.size(F.filter(letters, lambda y: y == x))
        return F.aggregate(F.array_distinct(s["a"]), F.lit(0), lambda n, x: n + F.least(times(s["a"], x), times(s["b"], x)))

    return bound(F.struct(_letters(a).alias("a"), _letters(b).alias("b")), of)


def matches(expected: Column, read: Column) -> Column:
    """Coinciding characters of two plates, cleaned: the most of same places, common subsequence and common multiset.

    The multiset count is never below the other two, so it alone is evaluated. Nothing read: 0.
    """

    def of(s: Column) -> Column:
        none = (s["a"] == "") | (s["b"] == "") | (s["b"] == UNREAD.upper().replace(" ", ""))
        a, b = s["a"], s["b"]
        return F.when(none, F.lit(0)).when(a.contains(b), F.length(b)).when(b.contains(a), F.length(a)).otherwise(shared_letters(a, b))

    return bound(F.struct(F.coalesce(clean(expected), F.lit("")).alias("a"), F.coalesce(clean(read), F.lit("")).alias("b")), of)
