"""Chinese-restaurant seatings of many dishes at once.

`drawn` seats all customers of a dish at once, by the exact chances of its number of tables; what a model needs of a seating is that number.
`seated`, `changed` and `gibbs` keep each table, as ragged arrays (tables per dish, and their customers in one flat array), and move
one customer at a time: the plain form that `drawn` is tested against.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64

_U64 = np.uint64
_STRIDE = 0x9E3779B97F4A7C15
#: Customers of a dish whose chances come from a table of Stirling numbers (8 MB a discount); beyond, each number is integrated.
TABULATED = 1024
#: Weights in memory at once; nodes of an integral, and its reach in standard deviations.
BLOCK = 1 << 19
NODES, REACH = 64, 9.0
#: Chances below exp(-TAIL) of the largest are left out, which is beyond the precision of a uniform number.
TAIL = 45.0


def uniform(seed: np.ndarray, number: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from each dish's seed, so that a task that runs again draws the same."""
    return (mix64(seed + _U64(number * _STRIDE & (2**64 - 1))) >> _U64(11)) * 2.0**-53


def starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each dish."""
    return np.arange(int(counts.sum())) - np.repeat(starts(counts), counts)


def seated(customers: np.ndarray, strength: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first seating: about strength * log(customers) tables, the older ones larger. What follows is Gibbs sampling from there."""
    more = strength * np.log1p(np.maximum(customers - 1, 0) / (strength + 1.0))
    count = np.minimum(customers, 1 + np.floor(more + uniform(seed, 0))).astype(np.int64)
    at, dish = within(count), np.repeat(np.arange(len(count)), count)
    c, t = customers[dish].astype(float), count[dish].astype(float)
    share = (t / np.maximum(c, 1)) ** (at / np.maximum(t - 1, 1))
    size = np.floor(c * share / np.bincount(dish, share, len(count))[dish] + 1e-9).astype(np.int64)
    # The least share is one customer, so every table has one; what rounding leaves sits at the first table.
    size = np.maximum(size, 1)
    head = starts(count)[count > 0]
    size[head] += (customers - np.bincount(dish, size, len(count)).astype(np.int64))[count > 0]
    return count, size


def dealt(weights: np.ndarray, low: np.ndarray, high: np.ndarray, points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places in the running sum `weights` of evenly spaced points in [low, high) per dish, the first one at a random offset."""
    x = np.repeat(low, points) + (np.repeat(first, points) + within(points)) * np.repeat((high - low) / np.maximum(points, 1), points)
    return np.minimum(np.searchsorted(weights, x, "right"), len(weights) - 1)


def changed(count: np.ndarray, size: np.ndarray, delta: np.ndarray, strength: np.ndarray, discount: float, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dishes after -delta customers have left or delta have come, dealt evenly over the tables by the chances of each.

    Dishes without customers are seated from nothing.
    """
    customers = np.bincount(np.repeat(np.arange(len(count)), count), size, len(count)).astype(np.int64)
    fresh = customers == 0
    gone, come = np.where(fresh, 0, np.maximum(-delta, 0)), np.where(fresh, 0, np.maximum(delta, 0))
    size, start = size.copy(), starts(count)
    if gone.any():
        total = np.concatenate(([0], np.cumsum(size)))
        np.subtract.at(size, dealt(total[1:].astype(float), total[start].astype(float), total[start + count].astype(float), gone, uniform(seed, 1)), 1)
        size = np.maximum(size, 0)
    p = strength / (strength + np.maximum(customers - discount * count, 1e-9))
    opened = np.where(customers + delta > 0, np.floor(come * p + uniform(seed, 2)), 0).astype(np.int64)
    opened = np.minimum(opened, come)
    joining = come - opened
    if joining.any():
        weight = np.concatenate(([0.0], np.cumsum(size - discount * (size > 0))))
        np.add.at(size, dealt(weight[1:], weight[start], weight[start + count], joining, uniform(seed, 3)), 1)
    new_count, new_size = seated(np.where(fresh, np.maximum(delta, 0), 0), strength, seed)
    owner = np.concatenate([np.repeat(np.arange(len(count)), n) for n in (count, opened, new_count)])
    flat = np.concatenate([size, np.ones(int(opened.sum()), np.int64), new_size])
    order = np.argsort(owner, kind="stable")
    owner, flat = owner[order], flat[order]
    keep = flat > 0
    return np.bincount(owner[keep], minlength=len(count)), flat[keep]


def gibbs(count: np.ndarray, size: np.ndarray, total: np.ndarray, base: np.ndarray, strength: np.ndarray | float, discount: float, seed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """`steps` times, a random customer of every dish is removed and seated again, given all others.

    The customer joins a table with chance in proportion to its customers less the discount, or opens one in proportion to
    (strength + discount * tables of the restaurant) * base. total holds the restaurant's tables; of those, the dish's own are
    followed from step to step. A table that its last customer leaves is closed.
    """
    if not len(count):
        return count, size
    room = count + steps
    start = starts(room)
    end = start + room - 1
    flat = np.zeros(int(room.sum()), np.int64)
    flat[within(count) + np.repeat(start, count)] = size
    customers = np.add.reduceat(flat, start)
    tables, used = count.copy(), count.copy()
    for k in range(steps):
        place = np.cumsum(flat)
        i = np.searchsorted(place, place[start] - flat[start] + np.floor(uniform(seed, 8 * k + 10) * customers).astype(np.int64), "right")
        flat[i] -= 1
        tables -= flat[i] == 0
        opening = (strength + discount * (total + tables - count)) * base
        new = (uniform(seed, 8 * k + 11) * (opening + customers - 1 - discount * tables) < opening) | (tables == 0)
        weight = np.cumsum(flat - discount * (flat > 0))
        low = weight[start] - (flat[start] - discount * (flat[start] > 0))
        j = np.searchsorted(weight, low + uniform(seed, 8 * k + 12) * (weight[end] - low), "right")
        # Rounding may point just beyond a dish's last table; such a customer returns to where it sat if that table is left, or opens one.
        j = np.where((j < start) | (j > end), i, j)
        new |= flat[np.minimum(j, len(flat) - 1)] == 0
        j = np.where(new, start + used, j)
        flat[j] += 1
        used += new
        tables += new
    keep = flat > 0
    return np.add.reduceat(keep, start, dtype=np.int64), flat[keep]


@lru_cache(4)
def stirling_table(discount: float, size: int = TABULATED) -> np.ndarray:
    """[c - 1, t - 1]: log of the sum, over all seatings of c customers at t tables, of the product of (1 - d)(2 - d)...(s - 1 - d) by table."""
    out = np.full((size, size), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, size):
        out[c, :c] = out[c - 1, :c] + np.log(c - discount * np.arange(1, c + 1))
        out[c, 1 : c + 1] = np.logaddexp(out[c, 1 : c + 1], out[c - 1, :c])
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1."""
    y = x + 8.0
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def _sizes(z: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """log(1 - (1 - e^z)^d), where e^z marks the customers of one table, and its derivative for real z."""
    near = np.maximum(z.real, -5.0) + (z - z.real)
    q = -np.expm1(near)
    f = -np.expm1(discount * np.log(q))
    out, slope = np.log(f), discount * np.exp(near) * q ** (discount - 1) / f
    far = z.real < -4.5
    if far.any():
        # f / (d e^z) as a power series: what the difference from 1 would round off.
        w = np.exp(z[far])
        a = np.cumprod([1.0, *((k - discount) / (k + 1) for k in range(1, 10))])
        value = np.polyval(a[::-1], w)
        out[far], slope[far] = np.log(discount) + z[far] + np.log(value), np.polyval((a * np.arange(1, 11))[::-1], w) / value
    return out, slope


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """stirling_table's numbers for any c beyond it: c! / (t! d^t) times the coefficient of x^c in (1 - (1 - x)^d)^t.

    Few tables for the customers: by powers of (1 - x)^d, which nearly end after the first. Otherwise by Cauchy's integral
    through the saddle point, on a parabola that follows the steepest descent.
    """
    c, t = np.asarray(c, float), np.asarray(t, float)
    out, few, step = np.zeros(len(c)), t <= c**discount, BLOCK // 256
    for rows in np.split(np.flatnonzero(few), range(step, int(few.sum()), step)):
        out[rows] = _few(c[rows], t[rows], discount)
    rest = np.flatnonzero(~few & (t < c))
    for rows in np.split(rest, range(step, len(rest), step)):
        out[rows] = _saddle(c[rows], t[rows], discount)
    return np.where(t < c, out + log_gamma(c + 1) - log_gamma(t + 1) - t * np.log(discount), 0.0)


def _few(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    j = np.arange(1.0, 1000)
    each = log_gamma(discount * j + 1) - log_gamma(j + 1) - np.log(np.pi)
    j = j[: 1 + int(np.argmax(each < -TAIL))]
    sign = np.where(j % 2, 1, -1) * np.sin(np.pi * np.mod(discount * j, 2))
    t, c = t[:, None], c[:, None]
    left = t - j
    terms = each[: len(j)] + log_gamma(t + 1) - log_gamma(np.maximum(left, 0) + 1) + log_gamma(np.maximum(c - discount * j, 1)) - log_gamma(c + 1)
    terms = np.where(left >= 0, terms, -np.inf)
    top = terms.max(axis=1, initial=-np.inf, keepdims=True)
    return top[:, 0] + np.log((sign * np.exp(terms - top)).sum(axis=1))


def _saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    low, high = np.full(len(c), -60.0), np.full(len(c), 4.0)
    for _ in range(64):
        middle = (low + high) / 2
        above = t * _sizes(-np.exp(middle), discount)[1] > c
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    z = -np.exp((low + high) / 2)
    h = -1e-4 * z
    slopes = [t * _sizes(z + k * h, discount)[1] for k in (-1, 0, 1)]
    second = (slopes[2] - slopes[0]) / (2 * h)
    bend = (slopes[2] - 2 * slopes[1] + slopes[0]) / (h * h) / (6 * second)
    # Almost as many tables as customers: the whole period, on a straight line.
    width = np.minimum(REACH / np.sqrt(second), np.pi)
    bend = np.where(width < np.pi, bend, 0.0)
    y = (np.arange(NODES) + 0.5) * (width / NODES)[:, None]
    move = bend[:, None] * y * y + 1j * y
    peak = _sizes(z, discount)[0]
    power = t[:, None] * (_sizes(z[:, None] + move, discount)[0] - peak[:, None]) - c[:, None] * move
    value = (np.exp(power) * (1 - 2j * bend[:, None] * y)).real
    return t * peak - c * z + np.log(value.sum(axis=1) * width / (NODES * np.pi))


def _usual(c: np.ndarray, strength: np.ndarray, base: np.ndarray, discount: float) -> np.ndarray:
    """About the likeliest number of tables: where one table more changes neither way, at a saddle point."""
    low, high = np.full(len(c), -60.0), np.full(len(c), 4.0)
    for _ in range(64):
        middle = (low + high) / 2
        value, slope = _sizes(-np.exp(middle), discount)
        t = c / slope
        more = value - np.log(t * discount) + np.log((strength + discount * t) * base) > 0
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return np.clip(c / _sizes(-np.exp((low + high) / 2), discount)[1], 1, c)


def drawn(customers: np.ndarray, strength: np.ndarray, base: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    """Tables per dish when all its customers have left and are seated again, given all other dishes: a Gibbs step of the whole dish.

    The j-th table (from 0) opens by (strength + discount * j) * base, where strength includes the discounts of the other dishes'
    tables; a customer joins a table by its customers less the discount. chance is the uniform number that decides.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    ordered = customers[order]
    table = stirling_table(discount) if len(ordered) and ordered[-1] > 1 else None
    for c in np.unique(ordered[(ordered > 1) & (ordered <= TABULATED)]).tolist():
        a, b = np.searchsorted(ordered, c), np.searchsorted(ordered, c, "right")
        step = max(1, BLOCK // c)
        for at in range(a, b, step):
            rows = order[at : min(at + step, b)]
            weight = np.log((strength[rows, None] + discount * np.arange(c)) * base[rows, None])
            np.cumsum(weight, axis=1, out=weight)
            weight += table[c - 1, :c]
            weight -= weight.max(axis=1, keepdims=True)
            np.cumsum(np.exp(weight, out=weight), axis=1, out=weight)
            out[rows] = 1 + np.minimum((weight <= (chance[rows] * weight[:, -1])[:, None]).sum(axis=1), c - 1)
    rows = order[np.searchsorted(ordered, TABULATED, "right") :]
    if len(rows):
        middle = _usual(customers[rows].astype(float), strength[rows], base[rows], discount)
        for r, m in zip(rows.tolist(), middle.tolist()):
            out[r] = _of_many(int(customers[r]), float(strength[r]), float(base[r]), discount, float(chance[r]), round(m))
    return out


def _of_many(c: int, strength: float, base: float, discount: float, chance: float, middle: int) -> int:
    reach = int(8 * middle**0.5) + 12
    while True:
        low, high = max(1, middle - reach), min(c, middle + reach)
        t = np.arange(low, high + 1)
        weight = log_stirling(np.full(len(t), c), t, discount) + np.cumsum(np.log((strength + discount * (t - 1)) * base))
        weight -= weight.max()
        if (low == 1 or weight[0] < -TAIL) and (high == c or weight[-1] < -TAIL):
            total = np.cumsum(np.exp(weight))
            return low + min(int(np.searchsorted(total, chance * total[-1], "right")), len(t) - 1)
        reach *= 2
