"""Component identifiers: Verhoeff digits, parsing, composing and taking apart.

Column forms run on the JVM with built-in functions only. parse_id and compose_id do the same for
single values on the driver (command line, constraint parser).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPONENTS = ("Concept", "Description", "Relationship")


def dihedral(a: int, b: int) -> int:
    """The product in the dihedral group of order ten: 0-4 turn, 5-9 flip."""
    turn = (a % 5 + (b % 5 if a < 5 else -b % 5)) % 5
    return turn + 5 * ((a < 5) != (b < 5))


PRODUCT = [dihedral(a, b) for a in range(10) for b in range(10)]
# fixed value: the permutation that the check digit scheme applies by place
STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
PLACES = reduce(lambda rows, _: [*rows, [rows[-1][STEP[d]] for d in range(10)]], range(7), [list(range(10))])
INVERSE = [next(b for b in range(10) if dihedral(a, b) == 0) for a in range(10)]


def fold(digits: str, first: int) -> int:
    out = 0
    for i, d in enumerate(reversed(digits)):
        out = PRODUCT[out * 10 + PLACES[(i + first) % 8][int(d)]]
    return out


def bound(value: Column, then) -> Column:
    """then(value) with the value computed once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _table(values: list[int]) -> Column:
    """A list of small numbers as one literal once the plan is folded."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _pair_table(offset: int) -> list[int]:
    """Products of a pair of digits at places offset and offset + 1: by both digits (0-99), by one where there is no other (100-109)."""
    low, high = PLACES[offset % 8], PLACES[(offset + 1) % 8]
    return [PRODUCT[low[v % 10] * 10 + high[v // 10]] for v in range(100)] + [low[v] for v in range(10)]


def _fold_number(value: Column, has: Callable[[int], Column], first: int, most: int) -> Column:
    """fold() of a long of `most` digits at the most: a table look-up for each two, then one for each product. has(i): whether there is a digit at place i."""
    pairs = [_table(_pair_table(first + k)) for k in range(0, 8, 2)]
    product = _table(PRODUCT)

    def rest(k: int) -> Column:
        if 2 * k >= most:
            return F.lit(0)
        two = (_div(value, 100**k) if k else value) % 100
        own = F.get(pairs[k % 4], F.when(has(2 * k + 1), two).otherwise(two + 100).cast("int"))
        return F.when(has(2 * k), F.get(product, own * 10 + rest(k + 1))).otherwise(0)

    return rest(0)


def _fold_column(s: Column, first: int) -> Column:
    """`s` should be a column or bound: digits, of any number. Up to 18 are read as a long, more are folded one by one."""
    n = F.length(s)
    places, product = _table([x for row in PLACES for x in row]), _table(PRODUCT)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(places, F.pmod(i - 1 + first, F.lit(8)) * 10 + F.substring(s, n - i + 1, F.lit(1)).cast("int")))
    return F.when(n <= 18, _fold_number(s.cast("long"), lambda i: n > i, first, 18)).otherwise(F.aggregate(digits, F.lit(0), lambda c, p: F.get(product, c * 10 + p)))


def verhoeff_valid(s: Column) -> Column:
    """Whether a string is digits that end in their check digit; false for null, empty or other text."""
    return F.coalesce(bound(s, lambda x: F.when(x.rlike("^[0-9]+$"), _fold_column(x, 0) == 0)), F.lit(False))


def verhoeff_digit(s: Column) -> Column:
    """The check digit that a string of digits needs, as a string; null for other text."""
    return bound(s, lambda x: F.when(x.rlike("^[0-9]+$"), F.get(_table(INVERSE), _fold_column(x, 1)).cast("string")))


class IdError(ValueError):
    """kind: InvalidLength, NonDigit, LeadingZero, CheckDigit, InvalidPartition, ZeroItemIdentifier or InvalidNamespace."""

    def __init__(self, kind: str, value: int | None = None):
        super().__init__(kind if value is None else f"{kind}({value})")
        self.kind, self.value = kind, value


def parse_id(s: str) -> int:
    n = len(s.encode())
    if not 6 <= n <= 18:
        raise IdError("InvalidLength", n)
    if not (s.isascii() and s.isdigit()):
        raise IdError("NonDigit")
    if s[0] == "0":
        raise IdError("LeadingZero")
    if fold(s, 0):
        raise IdError("CheckDigit")
    part = int(s[-3:-1])
    if part % 10 > 2 or part > 12:
        raise IdError("InvalidPartition", part)
    if part >= 10 and n < 11:
        raise IdError("InvalidLength", n)
    return int(s)


def compose_id(item: int, component: str = "Concept", namespace: int | None = None) -> int:
    if item <= 0:
        raise IdError("ZeroItemIdentifier")
    if namespace is not None and not 0 <= namespace <= 9_999_999:
        raise IdError("InvalidNamespace", namespace)
    body = f"{item}{'' if namespace is None else f'{namespace:07}'}{'0' if namespace is None else '1'}{COMPONENTS.index(component)}"
    return parse_id(body + str(INVERSE[fold(body, 1)]))


def id_error(s: Column) -> Column:
    """Null for a good id, else what is wrong, first fault first; InvalidLength and InvalidPartition carry the value."""
    return bound(s, _error)


def _error(s: Column) -> Column:
    n, part = F.octet_length(s), F.substring(s, -3, 2).cast("int")
    length = F.concat(F.lit("InvalidLength("), n.cast("string"), F.lit(")"))
    return (
        F.when(s.isNull(), "InvalidLength(0)")
        .when(~n.between(6, 18), length)
        .when(~s.rlike("^[0-9]+$"), "NonDigit")
        .when(s.startswith("0"), "LeadingZero")
        .when(_fold_number(s.cast("long"), lambda i: n > i, 0, 18) != 0, "CheckDigit")
        .when((part % 10 > 2) | (part > 12), F.concat(F.lit("InvalidPartition("), part.cast("string"), F.lit(")")))
        .when((part >= 10) & (n < 11), length)
    )


def parsed_id(s: Column) -> Column:
    """The id as a long; null where id_error says what is wrong."""
    return bound(s, lambda x: F.when(_error(x).isNull(), x.cast("long")))


def composed_id(item: Column, component: str = "Concept", namespace: Column | None = None) -> Column:
    """The id of an item; null where none can be made. What is composed needs no parsing: only its length can be wrong.

    Arithmetic on longs. It is bound, which keeps it out of the generated code: inlined, two or three ids in a
    projection make methods too large for the JVM to compile.
    """
    kind, item = COMPONENTS.index(component), item.cast("long")
    if namespace is None:
        good, body = item.between(100, 10**15 - 1), item * 100 + kind
    else:
        namespace = namespace.cast("long")
        good, body = item.between(1, 10**8 - 1) & namespace.between(0, 9_999_999), item * 10**9 + namespace * 100 + (10 + kind)
    digit = lambda x: F.get(_table(INVERSE), _fold_number(x, lambda i: x >= 10**i, 1, 17))
    return bound(F.when(good, body), lambda x: F.when(x.isNotNull(), x * 10 + digit(x)))


def partition(i: Column) -> Column:
    return (_div(i, 10) % 100).cast("int")


def check_digit(i: Column) -> Column:
    return (i % 10).cast("int")


def is_long_format(i: Column) -> Column:
    return _div(i, 100) % 10 == 1


def component_type(i: Column) -> Column:
    kind = _div(i, 10) % 10
    return F.when(kind == 0, "Concept").when(kind == 1, "Description").when(kind == 2, "Relationship")


def namespace(i: Column) -> Column:
    return F.when(is_long_format(i), (_div(i, 1000) % 10_000_000).cast("int"))


def item_identifier(i: Column) -> Column:
    return F.when(is_long_format(i), _div(i, 10**10)).otherwise(_div(i, 1000))


def _div(i: Column, by: int) -> Column:
    """Whole division of longs: ids have up to 18 digits, more than a double holds."""
    return F.call_function("div", i.cast("long"), F.lit(by).cast("long"))
