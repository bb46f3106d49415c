"""Running values over an array, as one expression whose size doesn't depend on the array.

Every round combines each element with the one a power of two before it, so n elements take n log n steps and no
element is compared with all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.columns import let

#: Distances of the rounds; arrays are shorter than the last. As text, since a plan with many scans is built quickly only so.
ROUNDS = f"array({','.join(str(1 << k) for k in range(31))})"


def running_max(values: Column) -> Column:
    """For each place the largest value up to and with it; nulls are passed over."""

    def scan(held: Column) -> Column:
        rounds = F.filter(F.expr(ROUNDS), lambda r: r < F.size(held))
        return F.aggregate(rounds, held, lambda acc, r: F.transform(acc, lambda x, i: F.greatest(x, F.get(acc, i - r))))

    return let(values, scan)


def running_sum(values: Column) -> Column:
    """For each place the sum of the values up to and with it."""

    def scan(held: Column) -> Column:
        rounds = F.filter(F.expr(ROUNDS), lambda r: r < F.size(held))
        return F.aggregate(rounds, held, lambda acc, r: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - r), F.lit(0))))

    return let(values, scan)


def halving_steps(values: Column) -> Column:
    return F.reverse(F.filter(F.expr(ROUNDS), lambda r: r <= F.size(values)))


def places_before(values: Column, steps: Column, before: Callable[[Column], Column]) -> Column:
    """How many of the values hold ``before``, which the first ones do and no later one, by their halving steps."""
    return F.aggregate(steps, F.lit(0), lambda n, r: F.when(before(F.get(values, n + r - 1)), n + r).otherwise(n))


def next_place(flags: Column, base: Column | int = 0) -> Column:
    """For each place the first flagged place from it on, counted from ``base``; NULL if there is none."""
    # Looked at from the end, the first place is the last one met: the largest of negated places.
    back = F.reverse(F.transform(flags, lambda f, i: F.when(f, -(i + base))))
    return F.transform(F.reverse(running_max(back)), lambda x: -x)


def marked(places: Column, keys: Column) -> Column:
    """For each of the rising ``places`` whether it is among ``keys``, by one sort of both."""
    both = F.concat(F.transform(keys, lambda k: F.struct(k.alias("at"), F.lit(0).alias("kind"))), F.transform(places, lambda p: F.struct(p.alias("at"), F.lit(1).alias("kind"))))

    def read(events: Column) -> Column:
        hit = F.transform(events, lambda e, i: F.struct(e["kind"].alias("kind"), F.coalesce((F.get(events, i - 1)["at"] == e["at"]), F.lit(False)).alias("hit")))
        return F.transform(F.filter(hit, lambda h: h["kind"] == 1), lambda h: h["hit"])

    return let(F.array_sort(both), read)


def among(values: Column, keys: Column) -> Column:
    """For each of ``values``, in any order, whether it is among ``keys``."""
    keyed = F.transform(keys, lambda k: F.struct(k.alias("at"), F.lit(-1).alias("i")))
    both = F.concat(keyed, F.transform(values, lambda v, i: F.struct(v.alias("at"), i.alias("i"))))

    def read(events: Column) -> Column:
        def answer(last: Column) -> Column:
            hit = F.transform(events, lambda e, j: F.struct(e["i"].alias("i"), F.coalesce(F.get(last, j) == e["at"], F.lit(False)).alias("hit")))
            return F.transform(F.array_sort(F.filter(hit, lambda h: h["i"] >= 0)), lambda h: h["hit"])

        return let(running_max(F.transform(events, lambda e: F.when(e["i"] < 0, e["at"]))), answer)

    return let(F.array_sort(both), read)


def grouped_places(keys: Column) -> Column:
    """For each of ``keys`` struct(place, size): its number among equal ones, from 1 in the order given, and their number."""

    def read(rows: Column) -> Column:
        first = running_max(F.transform(rows, lambda r, k: F.when((k == 0) | (F.get(rows, k - 1)["key"] != r["key"]), k)))
        # Seen from the end, a group's last row comes first.
        last = F.reverse(running_max(F.reverse(F.transform(rows, lambda r, k: F.when((k == F.size(rows) - 1) | (F.get(rows, k + 1)["key"] != r["key"]), -k)))))

        def place(b: Column) -> Column:
            out = F.transform(rows, lambda r, k: F.struct(r["i"].alias("i"), (k - F.get(b["first"], k) + 1).alias("place"), (-F.get(b["last"], k) - F.get(b["first"], k) + 1).alias("size")))
            return F.transform(F.array_sort(out), lambda o: F.struct(o["place"].alias("place"), o["size"].alias("size")))

        return let(F.struct(first.alias("first"), last.alias("last")), place)

    return let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("i")))), read)
