"""Reducing functions: what can be folded over a sequence, with identities where there are any."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..seq import IdentityNotDefinedError, Seq


@dataclass(frozen=True)
class Monoid:
    """aggregate(column, place) over a group; combine joins an initial value before it."""

    name: str
    aggregate: Callable[[Column, Column], Column]
    combine: Callable[[Column, Column], Column] | None = None
    identity: object | None = None

    def start(self) -> object:
        if self.identity is None:
            raise IdentityNotDefinedError(f"{self.name} has no identity; give an initial value")
        return self.identity


def _plain(f: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, _: f(x)


def _ordered(x: Column, place: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), x.alias("v")))), lambda r: r["v"])


MONOIDS = {
    m.name: m
    for m in (
        Monoid("sum", _plain(F.sum), lambda a, b: a + b, 0),
        Monoid("product", _plain(F.product), lambda a, b: a * b, 1),
        Monoid("min", _plain(F.min), F.least),
        Monoid("max", _plain(F.max), F.greatest),
        Monoid("count", _plain(F.count), lambda a, b: a + b, 0),
        Monoid("and", _plain(F.bool_and), lambda a, b: a & b, True),
        Monoid("or", _plain(F.bool_or), lambda a, b: a | b, False),
        Monoid("bit_and", _plain(F.bit_and), lambda a, b: a.bitwiseAND(b), -1),
        Monoid("bit_or", _plain(F.bit_or), lambda a, b: a.bitwiseOR(b), 0),
        Monoid("bit_xor", _plain(F.bit_xor), lambda a, b: a.bitwiseXOR(b), 0),
        Monoid("append", _ordered, F.concat),
        Monoid("union", _plain(F.collect_set), F.array_union),
        # the last and the first element, by place and never by arrival; the struct keeps nulls
        Monoid("right", lambda x, p: F.max_by(F.struct(x.alias("v")), p)["v"], lambda a, b: b),
        Monoid("left", lambda x, p: F.min_by(F.struct(x.alias("v")), p)["v"], lambda a, b: a),
        Monoid("mean", _plain(F.avg)),
        Monoid("variance", _plain(F.var_samp)),
        Monoid("deviation", _plain(F.stddev_samp)),
        Monoid("median", _plain(F.median)),
        Monoid("distinct", _plain(F.countDistinct)),
        Monoid("about_distinct", _plain(F.approx_count_distinct)),
    )
}


def reducing(kind: str, x: Column, s: Seq, where: Column | None = None) -> Column:
    """The aggregate of an expression over a sequence; `where` filters before it, and nulls then add nothing."""
    return MONOIDS[kind].aggregate(x if where is None else F.when(where, x), s.place())
