"""A calendar filled by walking rings: a fold that stops where its places end and resumes.

Day after day, and tier after tier within a day, an edition walks the tier's ring from a start
that moves with the day, and takes the first works that fit. What fits depends on all that was
taken before, so the walk is a fold; but what it must remember is bounded: the works of the
last weeks, the makers of the last days, the day's own picks. That state goes from round to
round as a row. A round brings each edition some places ahead of where it stands in every ring,
by an equality join, and the fold runs until it needs a place that it was not given. No edition
ever holds a tier, and no work is out of reach.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.operators.position import shared_folder

#: Places of a ring that an edition is given at first, by how much more after a round in which
#: it filled no set, and at most.
REACH, GROWTH, MOST = 64, 4, 1 << 16
_ROW = "edition long, d int, tier int, slot int, id string, relaxed int, first long, state string, reach int, done boolean"


@dataclass(frozen=True)
class Rules:
    """Works of a set, works of one style in it, days until a maker may come again in its tier
    and a work in any, both inclusive. The first pass keeps all rules, the second drops style
    and maker's gap, the third the work's gap; title and maker never come twice in a set."""

    works: int = 5
    style_cap: int = 2
    maker_gap: int = 5
    work_gap: int = 21

    def fits(self, p: int, work: tuple, got: list, makers: set, works: set) -> bool:
        """Does a work (id, title, maker, style) fit in pass p (0 to 2) into what it got?"""
        i, title, maker, style = work
        if any(title == g[1] or (maker and maker == g[2]) for g in got) or (p < 2 and i in works):
            return False
        return p > 0 or not ((maker and maker in makers) or (style and sum(style == g[3] for g in got) >= self.style_cap))


def start(first: int, d: int, n: int, rules: Rules) -> int:
    return (first + d) * rules.works % n


def begun() -> dict:
    """d, t: the day and tier at hand; p, k: the pass and the places it has seen; got: the set
    so far; day: the day's works; works and makers: [day, id] and [day, tier, maker]."""
    return {"d": 0, "t": 0, "p": 0, "k": 0, "got": [], "day": [], "works": [], "makers": []}


def walk(s: dict, first: int, sizes: list[int], days: int, places: dict, rules: Rules) -> list[tuple]:
    """Fill sets until a place is missing or all days are done, and leave that in s; the rows
    (d, tier, slot, id, pass) of the sets that were filled. places: (tier, place) -> work."""
    out = []
    while s["d"] < days:
        d, t = s["d"], s["t"]
        n = sizes[t]
        recent = {i for e, i in s["works"] if d - e <= rules.work_gap} | set(s["day"])
        makers = {m for e, u, m in s["makers"] if u == t and d - e <= rules.maker_gap}
        while len(s["got"]) < rules.works and s["p"] < 3:
            if s["k"] == n:
                s["p"], s["k"] = s["p"] + 1, 0
                continue
            work = places.get((t, (start(first, d, n, rules) + s["k"]) % n))
            if work is None:
                return out
            if rules.fits(s["p"], work, s["got"], makers, recent):
                s["got"].append([*work, s["p"]])
            s["k"] += 1
        out += [(d, t, slot, g[0], g[4]) for slot, g in enumerate(s["got"])]
        s["makers"] = [x for x in s["makers"] if d - x[0] <= rules.maker_gap] + [[d, t, g[2]] for g in s["got"] if g[2]]
        s["day"] += [g[0] for g in s["got"]]
        s.update(t=t + 1, p=0, k=0, got=[])
        if s["t"] == len(sizes):
            s["works"] = [x for x in s["works"] if d - x[0] <= rules.work_gap] + [[d, i] for i in s["day"]]
            s.update(d=d + 1, t=0, day=[])
    return out


def fill(ring: DataFrame, editions: DataFrame, sizes: list[int], days: int, rules: Rules = Rules(), reach: int = REACH, most: int = MOST) -> DataFrame:
    """edition, d, tier, slot, id and relaxed (the pass that took the work, from 0).

    ring: tier (0 to len(sizes) - 1), pos, id, title, maker, style, the last three as they are
    compared; editions: edition, first (the number of its first day). sizes: of the rings, none
    of them 0.
    """
    def ahead(edition: int, first: int, state: str, reach: int) -> pd.DataFrame:
        """The places an edition is given: those it needs next, of every ring."""
        s, tiers, places = json.loads(state), [], []
        for t, n in enumerate(sizes):
            d = s["d"] + (t < s["t"])
            at = start(first, d, n, rules) + (s["k"] if t == s["t"] else 0)
            # what a walk has passed it may need again, from its start, in its next pass
            count = min(n, reach)
            tiers += [t] * count
            places += [(at + i) % n for i in range(count)]
        return pd.DataFrame({"edition": edition, "tier": tiers, "pos": places})

    def asked(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                yield ahead(r.edition, r.first, r.state, r.reach)

    def advance(key: tuple, states: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        r = states.iloc[0]
        s = json.loads(r.state)
        before = (s["d"], s["t"])
        places = {(t, p): (i, a, b, c) for t, p, i, a, b, c in given[["tier", "pos", "id", "title", "maker", "style"]].itertuples(index=False)}
        rows = [(key[0], d, t, slot, i, p, None, None, None, None) for d, t, slot, i, p in walk(s, int(r["first"]), sizes, days, places, rules)]
        wider = int(r.reach) if (s["d"], s["t"]) != before else min(most, int(r.reach) * GROWTH)
        rows.append((key[0], None, None, None, None, None, r["first"], json.dumps(s), wider, s["d"] >= days))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")])
        return out.astype({c: "Int64" for c in ("d", "tier", "slot", "relaxed", "first", "reach")} | {"done": "boolean"})

    states = editions.select(F.col("edition").cast("long"), F.col("first").cast("long"), F.lit(json.dumps(begun())).alias("state"), F.lit(reach).alias("reach"))
    spark, place, n = ring.sparkSession, shared_folder(ring.sparkSession, "fold"), 0
    while n == 0 or not states.isEmpty():
        given = states.mapInPandas(asked, "edition long, tier int, pos long").join(ring, ["tier", "pos"])
        moved = states.groupBy("edition").cogroup(given.groupBy("edition")).applyInPandas(advance, _ROW)
        moved.write.parquet(f"{place}/round={n}")
        states = spark.read.schema(_ROW).parquet(f"{place}/round={n}").where("NOT done").select("edition", "first", "state", "reach")
        n += 1
    return spark.read.schema(_ROW).parquet(place).where("state IS NULL").select("edition", "d", "tier", "slot", "id", "relaxed")
