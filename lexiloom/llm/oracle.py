"""SQL (DuckDB) for those queries that SQL can express."""

from __future__ import annotations

from lexiloom.plans.oracle import STORED

_PAIRS = f"""{STORED}, pairs as (select article, token, count(*)::bigint tf from stored group by all),
cols as (select token, sum(tf)::bigint col_n, count(*)::bigint df from pairs group by token),
marg as (select article, sum(tf)::bigint row_n from pairs group by article),
total as (select sum(tf)::double n, count(distinct article) articles from pairs)"""
_SCORED = f"""{_PAIRS}, scored as (select article, token, tf, df, tf * round(log10(articles / df), 4) score,
row_n * col_n / n e, row_n * col_n / n * (1 - row_n / n) * (1 - col_n / n) v from pairs join cols using (token) join marg using (article), total)"""


def build() -> dict[str, str]:
    return {
        "p2_found": f"with {_SCORED} select article, token from scored where score > 20",
        "p2_residuals": f"with {_SCORED} select article, token, tf, df, round(score, 6) score, round(case when v > 0 then (tf - e) / sqrt(v) else 0 end, 6) residual from scored",
        "p3_found": f"""with {_PAIRS} select 'rare' mark, token from cols where df < 3
union all select 'common', token from cols, total where df > 0.5 * articles""",
        "p3_frequencies": f"with {_PAIRS} select token, col_n occurrences, df articles, df < 3 rare, df > 0.5 * articles common from cols, total",
    }
