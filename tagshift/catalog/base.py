"""Registry of named queries and the shared pieces of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.functions.jets import PAIRINGS, PAIRS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded double, so that the order of summation does not show."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double"), digits)


def big(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def R(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0.0)"


def B(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def signed_root(x: str) -> str:
    return f"sign({x}) * sqrt(abs({x}))"


def wrapped(x: str) -> str:
    return f"((({x}) + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi()"


def unsigned(x: str) -> str:
    return f"((({x}) % (2 * pi()) + 2 * pi()) % (2 * pi()))"


_FIELDS = ("pt", "eta", "phi", "m")


def _sum(template: str, n: int = 4) -> str:
    return " + ".join(template.format(i=i) for i in range(n))


def mass_of(ids, kind: str = "") -> str:
    """Invariant mass of a sum of vectors named px0, px1, ... or d01x, ..."""
    parts = {c: "(" + " + ".join(f"p{c}{i}" if c != "e" else f"e{i}" for i in ids) + ")" for c in "xyze"}
    m2 = f"({parts['e']} * {parts['e']} - {parts['x']} * {parts['x']} - {parts['y']} * {parts['y']} - {parts['z']} * {parts['z']})"
    return signed_root(m2)


def scaled_mass(a: str, b: str, target: str) -> str:
    """Mass of two dijets after each is scaled to the mass ``target``."""
    parts = {c: f"(d{a}{c} * {target} / m{a} + d{b}{c} * {target} / m{b})" for c in "xyze"}
    m2 = f"({parts['e']} * {parts['e']} - {parts['x']} * {parts['x']} - {parts['y']} * {parts['y']} - {parts['z']} * {parts['z']})"
    return signed_root(m2)


JET_KINEMATICS = """30 + l_extendedprice / 500 AS pt, (l_discount * 100 - 5) * 0.5 AS eta,
       l_quantity * 2 * pi() / 50 - pi() AS phi, 5 + l_tax * 100 AS m"""

_vec_columns = ", ".join(
    f"sqrt(pt{i} * pt{i} * cosh(eta{i}) * cosh(eta{i}) + m{i} * m{i}) AS e{i}, pt{i} * cos(phi{i}) AS px{i}, "
    f"pt{i} * sin(phi{i}) AS py{i}, pt{i} * sinh(eta{i}) AS pz{i}"
    for i in range(4)
)
_dijet_sums = ", ".join(
    f"px{p[0]} + px{p[1]} AS d{p}x, py{p[0]} + py{p[1]} AS d{p}y, pz{p[0]} + pz{p[1]} AS d{p}z, e{p[0]} + e{p[1]} AS d{p}e"
    for p in PAIRS
)
_dijet_terms = ", ".join(
    f"{signed_root(f'(d{p}e * d{p}e - d{p}x * d{p}x - d{p}y * d{p}y - d{p}z * d{p}z)')} AS m{p}, "
    f"sqrt(d{p}x * d{p}x + d{p}y * d{p}y) AS pt{p}, "
    f"sqrt((eta{p[0]} - eta{p[1]}) ** 2 + ({wrapped(f'phi{p[0]} - phi{p[1]}')}) ** 2) AS dR{p}"
    for p in PAIRS
)
_quad_dirs = ", ".join(f"asinh(d{p}z / pt{p}) AS eta{p}, atan2(d{p}y, d{p}x) AS phi{p}" for p in PAIRS)
_quad_terms = ", ".join(
    f"sqrt((eta{a} - eta{b}) ** 2 + ({wrapped(f'phi{a} - phi{b}')}) ** 2) AS dR{a}{b}, {scaled_mass(a, b, '91')} AS mZZ{a}{b}"
    for a, b in PAIRINGS
)


def pairing_cte(lead: str, subl: str, tie: str) -> str:
    """Best allowed pairing per event; ``lead`` and ``subl`` are conditions on {dr}."""
    parts = []
    for idx, (a, b) in enumerate(PAIRINGS):
        swap = f"(pt{b[0]} + pt{b[1]} {tie} pt{a[0]} + pt{a[1]})"
        parts.append(
            f"SELECT event_id, {idx} AS idx, m4j, abs(m{a} - m{b}) AS gap, "
            f"CASE WHEN {swap} THEN dR{b} ELSE dR{a} END AS lead_dr, CASE WHEN {swap} THEN dR{a} ELSE dR{b} END AS subl_dr, "
            f"CASE WHEN {swap} THEN m{b} ELSE m{a} END AS lead_m, CASE WHEN {swap} THEN m{a} ELSE m{b} END AS subl_m, "
            f"{scaled_mass(a, b, '125')} AS mhh FROM quad"
        )
    union = " UNION ALL ".join(parts)
    return (
        f"SELECT event_id, idx, gap, lead_m, subl_m, mhh FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, idx) AS k "
        f"FROM ({union}) u WHERE {lead.format(dr='lead_dr')} AND {subl.format(dr='subl_dr')}) s WHERE k = 1"
    )


CTES: dict[str, tuple[list[str], str]] = {
    "jets_ranked": ([], f"""SELECT l_orderkey AS event_id, rn - 1 AS jet, n, {JET_KINEMATICS}
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn,
              count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) t"""),
    "ev": (["jets_ranked"], "SELECT event_id, " + ", ".join(
        f"max(CASE WHEN jet = {i} THEN {c} END) AS {c}{i}" for i in range(4) for c in _FIELDS
    ) + " FROM jets_ranked WHERE n >= 4 AND jet < 4 GROUP BY event_id"),
    "vec": (["ev"], f"SELECT *, {_vec_columns} FROM ev"),
    "events4": (["vec"], f"""SELECT *, round(1 / (1 + exp(-(sT - 618) / 200)), 3) AS h,
            round(1 / (1 + exp(-(m4j - 1200) / 400)), 3) AS svb
        FROM (SELECT *, round({_sum('pt{i}')}, 5) AS sT, {_sum('pz{i}')} AS sum_pz, {mass_of('0123')} AS m4j,
            CASE WHEN event_id % 7 = 0 THEN '4b' ELSE '3b' END AS tag,
            CASE WHEN event_id % 10 < 3 THEN 'SR' WHEN event_id % 10 < 7 THEN 'CR' ELSE 'SB' END AS region,
            0.5 + (event_id % 5) / 10 AS weight,
            CASE WHEN event_id % 11 = 0 THEN -0.5 ELSE 0.5 + (event_id % 5) / 10 END AS signed_weight FROM vec) v"""),
    "dij": (["events4"], f"SELECT *, {_dijet_terms} FROM (SELECT *, {_dijet_sums} FROM events4) v"),
    "quad": (["dij"], f"SELECT *, {_quad_terms} FROM (SELECT *, {_quad_dirs} FROM dij) v"),
    "pair_sel": (["quad"], pairing_cte(
        "{dr} > 360 / m4j - 0.5 AND {dr} < greatest(650 / m4j + 0.5, 1.5)",
        "{dr} > 235 / m4j AND {dr} < greatest(650 / m4j + 0.7, 1.5)", ">")),
    "pair_plane": (["quad"], pairing_cte(
        "(CASE WHEN m4j < 1250 THEN {dr} > 360 / m4j - 0.5 AND {dr} < 653 / m4j + 0.977 ELSE {dr} < 1 END)",
        "(CASE WHEN m4j < 1250 THEN {dr} > 235 / m4j AND {dr} < 875 / m4j + 0.8 ELSE {dr} < 1 END)", ">=")),
    "near": (["quad"], "SELECT event_id, " + ", ".join(f"round(dR{p}, 9) AS r{p}" for p in PAIRS) + " FROM quad"),
    "wide": (["quad", "pair_sel", "near"], """SELECT q.*, coalesce(p.mhh, 0) AS mHH,
            least(r01, r23, r02, r13, r03, r12) AS dRjjClose,
            CASE least(r01, r23, r02, r13, r03, r12) WHEN r01 THEN r23 WHEN r23 THEN r01 WHEN r02 THEN r13
                WHEN r13 THEN r02 WHEN r03 THEN r12 ELSE r03 END AS dRjjOther,
            (abs(eta0) + abs(eta1) + abs(eta2) + abs(eta3)) / 4 AS aveAbsEta
        FROM quad q JOIN near n ON q.event_id = n.event_id LEFT JOIN pair_sel p ON q.event_id = p.event_id"""),
    "signal": ([], """SELECT o_orderkey AS event_id,
            CASE WHEN o_orderkey % 10 < 3 THEN 'SR' WHEN o_orderkey % 10 < 7 THEN 'CR' WHEN o_orderkey % 10 < 9 THEN 'SB' ELSE 'none' END AS region,
            CASE WHEN o_orderkey % 3 = 0 THEN 'zz' ELSE 'zh' END AS signal_class, o_totalprice / 100000 AS weight
        FROM orders"""),
    "norms": (["events4"], """SELECT w3b_CR, w3b_SR, w4b_CR, w4b_CR / w3b_CR AS pi FROM (SELECT
            sum(CASE WHEN tag = '3b' AND region = 'CR' THEN weight END) AS w3b_CR,
            sum(CASE WHEN tag = '3b' AND region = 'SR' THEN weight END) AS w3b_SR,
            sum(CASE WHEN tag = '4b' AND region = 'CR' THEN weight END) AS w4b_CR FROM events4) t"""),
}


def define(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


def sql(needs: str | list[str], body: str) -> str:
    """``body`` preceded by the shared views it needs, each once and in order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for n in CTES[name][0]:
            visit(n)
        done.append(name)

    for n in needs.split() if isinstance(needs, str) else needs:
        visit(n)
    views = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    return f"WITH {views}\n{body}" if views else body
