"""Ingestion, joins, splits, metrics and scalar operators as SQL plans; each takes a dialect and returns one statement."""

from __future__ import annotations

from courtlake.functions.dialect import Dialect
from courtlake.plans.base import GAMES, TEAM_GAMES, TEAMS, W, before, previous
from courtlake.plans.features import _wide_cte


def games_view(d: Dialect) -> str:
    return f"WITH {GAMES} SELECT * FROM games"


def team_games(d: Dialect) -> str:
    return f"WITH {TEAM_GAMES} SELECT game_id, game_date, season, team, opp, CAST(is_home AS BIGINT) AS is_home, CAST(win AS BIGINT) AS win, CAST(diff AS BIGINT) AS diff FROM tg"


def season_of_date(d: Dialect) -> str:
    y = "CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END"
    return f"SELECT o_orderkey, CAST({y} AS STRING) || '/' || right(CAST({y} + 1 AS STRING), 2) AS season FROM orders"


def postponed_split(d: Dialect) -> str:
    # Scores missing or not above zero mean postponed; an away score only counts as missing with the reference's precedence.
    return f"""WITH {GAMES}, m AS (SELECT game_id, CASE WHEN game_id % 31 = 0 THEN NULL WHEN game_id % 29 = 0 THEN 0 ELSE home_score END AS hs,
       CASE WHEN game_id % 37 = 0 THEN NULL WHEN game_id % 23 = 0 THEN 0 ELSE away_score END AS aws FROM games)
SELECT game_id, CAST(CASE WHEN COALESCE(hs <= 0, false) OR COALESCE(aws <= CASE WHEN hs IS NULL OR aws IS NULL THEN 1 ELSE 0 END, false) THEN 1 ELSE 0 END AS BIGINT) AS postponed FROM m"""


def regular_season_filter(d: Dialect) -> str:
    return f"""WITH {GAMES} SELECT game_id, season, label FROM games
WHERE CASE WHEN season < '1996/97' THEN NOT COALESCE(label IN ('Preseason'), false)
           WHEN season < '1999/00' THEN NOT COALESCE(label IN ('Preseason', 'Neutral Cup'), false)
           ELSE NOT COALESCE(label IN ('Preseason'), false) AND game_id <> 1 END"""


def neutral_label_flag(d: Dialect) -> str:
    return f"WITH {GAMES} SELECT game_id, COALESCE(label IN ('Neutral Cup'), false) AS is_neutral FROM games"


def add_conference(d: Dialect) -> str:
    return f"""WITH {GAMES}, {TEAMS} SELECT game_id, h.conf AS home_conference, a.conf AS away_conference, w.conf AS winner_conference FROM games g
LEFT JOIN teams h ON g.home = h.team LEFT JOIN teams a ON g.away = a.team LEFT JOIN teams w ON g.winner = w.team"""


def teams_locations(d: Dialect) -> str:
    return f"""WITH {GAMES}, loc AS (SELECT CAST(n_nationkey AS BIGINT) AS team, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_name || ', ' || CAST(n_regionkey AS STRING) END AS place FROM nation)
SELECT game_id, h.place AS home_location, a.place AS away_location, h.place AS game_location FROM games g LEFT JOIN loc h ON g.home = h.team LEFT JOIN loc a ON g.away = a.team"""


def _batches() -> str:
    return f"""{GAMES}, old AS (SELECT * FROM games WHERE game_id % 3 <> 0), new AS (SELECT game_id, game_date, home, away, home_score + 1 AS home_score, away_score FROM games WHERE game_id % 5 = 0)"""


def dedupe_keep_latest(d: Dialect) -> str:
    return f"""WITH {_batches()}
SELECT game_id, game_date, home, away, home_score FROM old WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.game_date = old.game_date AND n.home = old.home AND n.away = old.away)
UNION ALL SELECT game_id, game_date, home, away, home_score FROM new"""


def dedupe_incremental(d: Dialect) -> str:
    return f"""WITH {_batches()} SELECT game_id, game_date, home, away, home_score FROM old
UNION ALL SELECT game_id, game_date, home, away, home_score FROM new WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.game_id = new.game_id)"""


def drop_duplicates_first(d: Dialect) -> str:
    return """WITH k AS (SELECT event_id, user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id, user_id, event_type FROM k WHERE rn = 1"""


def next_slate(d: Dialect) -> str:
    return f"""WITH {GAMES}, played AS (SELECT game_id, game_date FROM games WHERE season_start < 1998 AND game_id % 11 <> 0),
last AS (SELECT MAX(game_date) AS day FROM played), open AS (SELECT g.game_id, g.game_date, g.home, g.away FROM games g WHERE NOT EXISTS (SELECT 1 FROM played p WHERE p.game_id = g.game_id)),
today AS (SELECT o.* FROM open o JOIN last l ON o.game_date = l.day), later AS (SELECT MIN(o.game_date) AS day FROM open o JOIN last l ON o.game_date > l.day)
SELECT * FROM today UNION ALL SELECT o.* FROM open o JOIN later ON o.game_date = later.day WHERE NOT EXISTS (SELECT 1 FROM today)"""


def location_pairs(d: Dialect) -> str:
    return "SELECT a.n_name AS city_from, b.n_name AS city_to, CAST((b.n_nationkey - a.n_nationkey) * 137 % 2500 + 50 AS BIGINT) AS miles FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"


def abbreviation_slug(d: Dialect) -> str:
    return f"""WITH {GAMES}, ab AS (SELECT CAST(n_nationkey AS BIGINT) AS team, lower(left(n_name, 3)) AS ab FROM nation)
SELECT game_id, 'game-' || a.ab || '-' || h.ab || '-' || CAST(game_date AS STRING) AS slug FROM games g JOIN ab h ON g.home = h.team JOIN ab a ON g.away = a.team"""


def _arenas(d: Dialect) -> str:
    return f"""{GAMES}, cnt AS (SELECT season, home, arena, COUNT(*) AS n FROM games GROUP BY season, home, arena),
share AS (SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY season, home) AS part FROM cnt)"""


def arena_share(d: Dialect) -> str:
    return f"""WITH {_arenas(d)} SELECT season, home AS team, {d.texts("CAST(arena AS STRING)", "arena")} AS home_arena_ids, COUNT(*) AS n_arenas FROM share WHERE part >= 0.2 GROUP BY season, home"""


def neutral_court(d: Dialect) -> str:
    return f"""WITH {_arenas(d)}, own AS (SELECT season, home, arena FROM share WHERE part >= 0.2), has AS (SELECT DISTINCT season, home FROM own)
SELECT g.game_id, CAST(CASE WHEN h.home IS NULL THEN 0 WHEN o.arena IS NULL THEN 1 ELSE 0 END AS BIGINT) AS neutral_court FROM games g
LEFT JOIN own o ON o.season = g.season AND o.home = g.home AND o.arena = g.arena LEFT JOIN has h ON h.season = g.season AND h.home = g.home"""


def _in_order(d: Dialect, table: str, name: str, by: str = "game_date") -> str:
    """``name``: game_id with its place ``rn`` along (``by``, game_id), nulls last, and the number ``n`` of all rows.

    Spark ranks within a value and adds what the values before it hold, so that no task sorts the whole table.
    """
    if not d.spark:
        return f"{name} AS (SELECT game_id, ROW_NUMBER() OVER (ORDER BY {by} NULLS LAST, game_id) AS rn, COUNT(*) OVER () AS n FROM {table})"
    return f"""{name}_held AS (SELECT {by} AS v, COUNT(*) AS held FROM {table} GROUP BY {by}),
{name}_before AS (SELECT v, SUM(held) OVER (ORDER BY v NULLS LAST) - held AS before, SUM(held) OVER () AS n FROM {name}_held),
{name} AS (SELECT t.game_id, b.before + ROW_NUMBER() OVER (PARTITION BY t.{by} ORDER BY t.game_id) AS rn, b.n FROM {table} t JOIN {name}_before b ON b.v <=> t.{by})"""


def temporal_split(d: Dialect) -> str:
    return f"""WITH {GAMES}, {_in_order(d, "games", "k")}
SELECT game_id, CASE WHEN rn > n - CAST(floor(n * 2.0e-1) AS BIGINT) THEN 'test' WHEN rn > n - CAST(floor(n * 2.0e-1) AS BIGINT) - CAST(floor(n * 2.0e-1) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM k"""


def fixed_holdout_split(d: Dialect) -> str:
    return f"""WITH {GAMES}, held AS (SELECT DISTINCT game_id FROM games WHERE season = '1999/00'),
others AS (SELECT game_id, game_date FROM games WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.game_id = games.game_id)), {_in_order(d, "others", "rest")}
SELECT game_id, 'test' AS split FROM held UNION ALL SELECT game_id, CASE WHEN rn > n - CAST(floor(n * 2.5e-1) AS BIGINT) THEN 'val' ELSE 'train' END FROM rest"""


def split_sizes(d: Dialect) -> str:
    return f"SELECT split, COUNT(*) AS n, MIN(game_id) AS first_game FROM ({temporal_split(d)}) s GROUP BY split"


def make_holdout_set(d: Dialect) -> str:
    return f"WITH {GAMES} SELECT DISTINCT game_id FROM games WHERE season >= '1998/99'"


def impute_mean(d: Dialect) -> str:
    return f"""WITH {_wide_cte(d)}, u AS (SELECT game_id, CAST(ROUND(record_L5_HT * 1e4) AS BIGINT) AS x FROM wide), m AS (SELECT CAST(SUM(x) AS DOUBLE) / COUNT(x) / 1e4 AS m FROM u)
SELECT game_id, {d.r('COALESCE(x / 1e4, m)', 4)} AS record_L5_HT FROM u CROSS JOIN m"""


def clip_percentiles(d: Dialect) -> str:
    q = "percentile(CAST(home_score AS DOUBLE), {p})" if d.spark else "quantile_cont(CAST(home_score AS DOUBLE), {p})"
    return f"""WITH {GAMES}, q AS (SELECT {q.format(p='0.01')} AS lo, {q.format(p='0.99')} AS hi FROM games)
SELECT game_id, {d.r('least(greatest(CAST(home_score AS DOUBLE), lo), hi)', 6)} AS home_score FROM games CROSS JOIN q"""


def one_hot_if_binary(d: Dialect) -> str:
    return f"""WITH {GAMES}, {TEAMS} SELECT game_id, CAST(CASE WHEN conf = 'West' THEN 1 ELSE 0 END AS BIGINT) AS conf_West,
 CAST(CASE WHEN COALESCE(label, 'none') = 'Preseason' THEN 1 ELSE 0 END AS BIGINT) AS label_Preseason, CAST(CASE WHEN COALESCE(label, 'none') = 'Regular' THEN 1 ELSE 0 END AS BIGINT) AS label_Regular
FROM games JOIN teams ON games.home = teams.team"""


def standard_scale(d: Dialect) -> str:
    return f"""WITH {GAMES}, m AS (SELECT CAST(SUM(home_score) AS DOUBLE) / COUNT(*) AS mean, CAST(SUM(home_score * home_score) AS DOUBLE) / COUNT(*) AS sq FROM games)
SELECT game_id, {d.r('(home_score - mean) / sqrt(sq - mean * mean)', 6)} AS scaled FROM games CROSS JOIN m"""


def _scored(d: Dialect) -> str:
    """A deterministic score in place of a model's: a logistic curve of the record delta, in ten-thousandths."""
    p = d.r("1 / (1 + exp(-3 * COALESCE(record_L13_HT - record_L13_VT, 0.0)))", 4)
    return f"""{_wide_cte(d)},
pred0 AS (SELECT game_id, season, game_date, home, away, home_conf, away_conf, games_played_HT, games_played_VT, win AS y, {p} AS p FROM wide),
pred AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat, CAST(ROUND(p * 1e4) AS BIGINT) AS pu FROM pred0),
ok AS (SELECT *, CASE WHEN y = yhat THEN 1 ELSE 0 END AS correct FROM pred)"""


def _acc(d: Dialect) -> str:
    return d.r("CAST(SUM(correct) AS DOUBLE) / COUNT(*)", 4)


def analysis_frame(d: Dialect) -> str:
    return f"WITH {_scored(d)} SELECT game_id, season, game_date, home, away, CAST(y AS BIGINT) AS y_true, CAST(yhat AS BIGINT) AS y_pred, CAST(correct AS BIGINT) AS correct, p AS y_proba FROM ok"


def record_baseline(d: Dialect) -> str:
    return f"WITH {_wide_cte(d)} SELECT game_id, CAST(CASE WHEN record_L13_HT - record_L13_VT >= 0 THEN 1 ELSE 0 END AS BIGINT) AS predicted FROM wide"


def point_diff_baseline(d: Dialect) -> str:
    return f"WITH {_wide_cte(d)} SELECT game_id, CAST(CASE WHEN pts_diff_avg_L13_HT - pts_diff_avg_L13_VT >= 0 THEN 1 ELSE 0 END AS BIGINT) AS predicted FROM wide"


def accuracy_by_season(d: Dialect) -> str:
    return f"WITH {_scored(d)} SELECT season, {_acc(d)} AS accuracy, COUNT(*) AS n FROM ok GROUP BY season"


def error_by_team(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, h AS (SELECT home AS team, SUM(correct) AS c, COUNT(*) AS n FROM ok GROUP BY home), a AS (SELECT away AS team, SUM(correct) AS c, COUNT(*) AS n FROM ok GROUP BY away)
SELECT COALESCE(h.team, a.team) AS team, {d.r('CAST(h.c AS DOUBLE) / h.n', 4)} AS home_accuracy, {d.r('CAST(a.c AS DOUBLE) / a.n', 4)} AS away_accuracy,
 {d.r('1 - CAST(COALESCE(h.c, 0) + COALESCE(a.c, 0) AS DOUBLE) / (COALESCE(h.n, 0) + COALESCE(a.n, 0))', 4)} AS error_rate FROM h FULL OUTER JOIN a ON h.team = a.team"""


def top_error_teams(d: Dialect) -> str:
    return f"WITH {_scored(d)} SELECT home AS team, {d.r('1 - CAST(SUM(correct) AS DOUBLE) / COUNT(*)', 4)} AS error_rate FROM ok GROUP BY home ORDER BY 2 DESC, 1 LIMIT 10"


def matchup_accuracy(d: Dialect) -> str:
    return f"WITH {_scored(d)} SELECT CASE WHEN home_conf = away_conf THEN 'same' ELSE 'different' END AS matchup, {_acc(d)} AS accuracy, COUNT(*) AS n FROM ok GROUP BY 1"


def overtime_accuracy(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, o AS (SELECT *, CASE WHEN game_id % 17 = 0 THEN 1 + game_id % 3 END AS overtimes FROM ok)
SELECT CASE WHEN overtimes > 0 THEN 'Overtime' ELSE 'Regular' END AS game_type, {_acc(d)} AS accuracy, COUNT(*) AS n FROM o GROUP BY 1"""


def neutral_court_accuracy(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, o AS (SELECT ok.*, COALESCE(g.label = 'Neutral Cup', false) AS is_neutral FROM ok JOIN games g ON g.game_id = ok.game_id)
SELECT CASE WHEN is_neutral THEN 'Neutral Court' ELSE 'Home Court' END AS court_type, {_acc(d)} AS accuracy, COUNT(*) AS n FROM o GROUP BY 1"""


def season_phase_accuracy(d: Dialect) -> str:
    g = "least(games_played_HT, games_played_VT) + 1"
    phase = "CASE " + " ".join(f"WHEN {g} <= {k} THEN '{k:02d}'" for k in (10, 20, 30, 40, 50, 60, 70, 80, 82)) + " END"
    return f"WITH {_scored(d)}, b AS (SELECT *, {phase} AS phase FROM ok) SELECT phase, {_acc(d)} AS accuracy, COUNT(*) AS n FROM b WHERE phase IS NOT NULL GROUP BY phase"


def margin_calibration(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, m AS (SELECT ok.*, g.home_score - g.away_score AS margin FROM ok JOIN games g ON g.game_id = ok.game_id),
e AS (SELECT MIN(margin) AS lo, CAST(MAX(margin) - MIN(margin) AS DOUBLE) / 15 AS width FROM m),
b AS (SELECT m.*, CAST(least(greatest(ceil((margin - lo) / width), 1), 15) AS BIGINT) AS bin FROM m CROSS JOIN e)
SELECT bin, COUNT(*) AS n, {d.r('CAST(SUM(pu) AS DOUBLE) / COUNT(*) / 1e4', 4)} AS mean_probability, {d.r('CAST(SUM(y) AS DOUBLE) / COUNT(*)', 4)} AS win_rate FROM b GROUP BY bin"""


def brier_ece(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, bb AS (SELECT y, correct, pu, CAST(greatest(ceil(pu / 1.0e3), 1) AS BIGINT) AS bin FROM ok),
per AS (SELECT bin, COUNT(*) AS n, ABS(SUM(y) * 10000 - SUM(pu)) AS gap FROM bb GROUP BY bin),
ece AS (SELECT CAST(SUM(gap) AS DOUBLE) / SUM(n) / 1e4 AS ece FROM per),
br AS (SELECT CAST(SUM((pu - y * 10000) * (pu - y * 10000)) AS DOUBLE) / COUNT(*) / 1e8 AS brier, CAST(SUM(correct) AS DOUBLE) / COUNT(*) AS acc FROM bb)
SELECT {d.r('brier', 4)} AS brier, {d.r('ece', 4)} AS ece, {d.r('acc', 4)} AS accuracy FROM br CROSS JOIN ece"""


def regression_metrics(d: Dialect) -> str:
    # The share of a miss in what was to be forecast, in whole billionths, so that the sum is exact in any order.
    share = "CAST(ROUND(ABS((y - f) / (y + 1e-8)) * 1e9) AS BIGINT)"
    return f"""WITH {TEAM_GAMES}, x AS (SELECT CAST(diff AS BIGINT) AS y, CAST(COALESCE(ROUND({previous('diff', 5)}), 0) AS BIGINT) AS f FROM tg),
s AS (SELECT COUNT(*) AS n, SUM((y - f) * (y - f)) AS sse, SUM(ABS(y - f)) AS sae, SUM(y) AS sy, SUM(y * y) AS syy, SUM({share}) AS miss FROM x)
SELECT {d.r('CAST(sse AS DOUBLE) / n', 4)} AS mse, {d.r('sqrt(CAST(sse AS DOUBLE) / n)', 4)} AS rmse, {d.r('CAST(sae AS DOUBLE) / n', 4)} AS mae,
 {d.r('1 - CAST(sse AS DOUBLE) / (syy - CAST(sy AS DOUBLE) * sy / n)', 4)} AS r2, {d.r('CAST(miss AS DOUBLE) / n / 1e9 * 1e2', 4)} AS mape FROM s"""


def roc_auc(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, g AS (SELECT pu, SUM(y) AS pos, SUM(1 - y) AS neg FROM ok GROUP BY pu),
k AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY pu ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT {d.r('CAST(SUM(pos * (2 * below + neg)) AS DOUBLE) / (2.0e0 * SUM(pos) * SUM(neg))', 4)} AS roc_auc FROM k"""


def roc_points(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, g AS (SELECT pu, SUM(y) AS pos, SUM(1 - y) AS neg FROM ok GROUP BY pu)
SELECT pu AS threshold_units, CAST(SUM(pos) OVER (ORDER BY pu DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp, CAST(SUM(neg) OVER (ORDER BY pu DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp FROM g"""


def confusion_matrix(d: Dialect) -> str:
    return f"WITH {_scored(d)} SELECT CAST(y AS BIGINT) AS y_true, CAST(yhat AS BIGINT) AS y_pred, COUNT(*) AS n FROM ok GROUP BY y, yhat"


def accuracy_by_prob_bin(d: Dialect) -> str:
    return f"WITH {_scored(d)} SELECT CAST(least(floor(pu / 5.0e2), 19) AS BIGINT) AS bin, {_acc(d)} AS accuracy, COUNT(*) AS n FROM ok GROUP BY 1"


def reliability_points(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, b AS (SELECT *, CAST(least(floor(pu / 1.0e3), 9) AS BIGINT) AS bin FROM ok)
SELECT bin, {d.r('CAST(SUM(pu) AS DOUBLE) / COUNT(*) / 1e4', 4)} AS mean_predicted, {d.r('CAST(SUM(y) AS DOUBLE) / COUNT(*)', 4)} AS observed, COUNT(*) AS n FROM b GROUP BY bin"""


def null_summary(d: Dialect) -> str:
    """Spark counts all columns in one pass; the oracle asks column by column."""
    columns = ("record_L5_HT", "record_L5_VT", "last_win_HT", "home_conf")
    if d.spark:
        sums = ", ".join(f"COUNT_IF({c} IS NULL) AS {c}" for c in columns)
        pairs = ", ".join(f"'{c}', {c}" for c in columns)
        pct = d.r("1e2 * nulls / rows", 4)
        return f"""WITH {_wide_cte(d)}, one AS (SELECT COUNT(*) AS rows, {sums} FROM wide), long AS (SELECT rows, stack({len(columns)}, {pairs}) AS (column_name, nulls) FROM one)
SELECT column_name, CAST(nulls AS BIGINT) AS nulls, {pct} AS pct FROM long"""
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, {d.r(f'1e2 * SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / COUNT(*)', 4)} AS pct FROM wide" for c in columns)
    return f"WITH {_wide_cte(d)} {parts}"


def class_counts(d: Dialect) -> str:
    return f"WITH {_wide_cte(d)} SELECT CAST(win AS BIGINT) AS win, COUNT(*) AS n FROM wide GROUP BY win"


def phase_vs_baseline(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, b AS (SELECT ok.*, CAST(floor(games_played_HT / 1.0e1) AS BIGINT) AS phase, CASE WHEN y = 1 THEN 1 ELSE 0 END AS base FROM ok),
m AS (SELECT phase, {_acc(d)} AS accuracy FROM b GROUP BY phase), bl AS (SELECT phase, {d.r('CAST(SUM(base) AS DOUBLE) / COUNT(*)', 4)} AS accuracy FROM b GROUP BY phase)
SELECT m.phase, m.accuracy AS accuracy_model, bl.accuracy AS accuracy_baseline FROM m JOIN bl ON m.phase = bl.phase"""


def ot_parse(d: Dialect) -> str:
    s = "CASE event_id % 4 WHEN 0 THEN 'Final' WHEN 1 THEN 'Final/OT' WHEN 2 THEN 'Final/' || CAST(event_id % 3 + 2 AS STRING) || 'OT' ELSE NULL END"
    n = d.extract("s", "([0-9]+) *OT", 1)
    return f"""WITH e AS (SELECT event_id, {s} AS s FROM events)
SELECT event_id, CAST(CASE WHEN s IS NULL THEN 0 WHEN {n} <> '' THEN CAST(NULLIF({n}, '') AS BIGINT) WHEN s LIKE '%OT%' THEN 1 ELSE 0 END AS BIGINT) AS overtimes FROM e"""


def stake_sizing(d: Dialect) -> str:
    return f"""WITH {_scored(d)}, a AS (SELECT game_id, {d.r('p', 2)} AS p2, (40 + game_id % 30) / 1.0e2 AS ask FROM ok),
e AS (SELECT *, {d.r('(p2 - ask) / ask', 2)} AS edge FROM a) SELECT game_id, edge, {d.r('edge * 1.0e2 / ask', 2)} AS stake FROM e WHERE edge > 0"""


def ask_walk(d: Dialect) -> str:
    """Shares bought along three asks, cheapest first: each for (p - ask) / ask of what is left of 100, until one ask holds all that is wanted."""
    asks = [(f"(35 + game_id % 20 + {5 * k}) / 1.0e2", f"CAST(20 + (game_id + {7 * k}) % 60 AS BIGINT)") for k in range(3)]
    steps, left, going = [], "1.0e2", "TRUE"
    for k, (ask, size) in enumerate(asks):
        want = f"CAST(floor({d.r(f'(p2 - a{k}) / a{k}', 2)} * b{k} / a{k}) AS BIGINT)"
        steps.append(f"s{k} AS (SELECT *, {ask} AS a{k}, {size} AS z{k}, {left} AS b{k}, {going} AS g{k} FROM {'a' if k == 0 else f't{k - 1}'})")
        steps.append(f"t{k} AS (SELECT *, CASE WHEN g{k} AND p2 > a{k} THEN least({want}, z{k}) ELSE 0 END AS n{k}, g{k} AND p2 > a{k} AND {want} > z{k} AS more{k} FROM s{k})")
        left, going = f"b{k} - n{k} * a{k}", f"more{k}"
    return f"""WITH {_scored(d)}, a AS (SELECT game_id, {d.r('p', 2)} AS p2 FROM ok), {", ".join(steps)}
SELECT game_id, CAST(n0 AS BIGINT) AS shares_1, CAST(n1 AS BIGINT) AS shares_2, CAST(n2 AS BIGINT) AS shares_3, {d.r('n0 * a0 + n1 * a1 + n2 * a2', 4)} AS spent FROM t2 WHERE n0 > 0"""


def season_expand(d: Dialect) -> str:
    return f"""WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS team, CAST(1990 + n_nationkey AS INT) AS founded, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 2100 ELSE 1995 + n_nationkey END AS INT) AS till FROM nation),
y AS (SELECT team, {d.numbers('founded', 'least(till, 2001) - 1')} AS y FROM t WHERE founded <= least(till, 2001) - 1)
SELECT team, CAST(y AS STRING) || '/' || right(CAST(y + 1 AS STRING), 2) AS season FROM y"""


def prompt_text(d: Dialect) -> str:
    return f"""WITH {_scored(d)} SELECT game_id, 'Home ' || CAST(home AS STRING) || ' vs away ' || CAST(away AS STRING) || ': probability ' || CAST(CAST(ROUND({d.r('p', 2)} * 100) AS BIGINT) AS STRING) || ' %' AS prompt FROM ok"""


def coerce_numeric(d: Dialect) -> str:
    return f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END AS raw FROM events) SELECT event_id, {d.try_int('raw')} AS number FROM e"""


def fill_winner(d: Dialect) -> str:
    return f"""WITH {GAMES}, m AS (SELECT game_id, home, away, home_score, away_score, CASE WHEN game_id % 2 = 0 THEN winner END AS winner FROM games)
SELECT game_id, CASE WHEN winner IS NOT NULL THEN winner WHEN home_score > away_score THEN home WHEN away_score > home_score THEN away END AS winner FROM m"""


def union_reindex(d: Dialect) -> str:
    return f"WITH {GAMES} SELECT game_id, home_score, CAST(NULL AS BIGINT) AS attendance FROM games WHERE game_id % 2 = 0 UNION ALL SELECT game_id, CAST(NULL AS BIGINT), 10000 + game_id % 9000 FROM games WHERE game_id % 2 = 1"


def sort_nulls_last(d: Dialect) -> str:
    return f"""WITH {GAMES}, m AS (SELECT game_id, CASE WHEN game_id % 3 = 0 THEN NULL ELSE home_score END AS s FROM games), {_in_order(d, "m", "k", "s")}
SELECT m.game_id, m.s, CAST(k.rn AS BIGINT) AS place FROM m JOIN k ON k.game_id = m.game_id"""


def schedule_parse(d: Dialect) -> str:
    return f"WITH {GAMES} SELECT game_id, game_date FROM games WHERE NOT COALESCE(label = 'Preseason', false) AND home <> 0 AND away <> 0"


def required_nulls(d: Dialect) -> str:
    return f"WITH {GAMES} SELECT CAST(SUM(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS label_nulls, CAST(SUM(CASE WHEN winner IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS winner_nulls FROM games"


def events_by_hour(d: Dialect) -> str:
    return "SELECT date_trunc('hour', ts) AS hour, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2"


TABLES = [
    games_view, team_games, season_of_date, postponed_split, regular_season_filter, neutral_label_flag, add_conference, teams_locations, dedupe_keep_latest,
    dedupe_incremental, drop_duplicates_first, next_slate, location_pairs, abbreviation_slug, arena_share, neutral_court, temporal_split, fixed_holdout_split, split_sizes,
    make_holdout_set, impute_mean, clip_percentiles, one_hot_if_binary, standard_scale, analysis_frame, record_baseline, point_diff_baseline, accuracy_by_season,
    error_by_team, top_error_teams, matchup_accuracy, overtime_accuracy, neutral_court_accuracy, season_phase_accuracy, margin_calibration, brier_ece, regression_metrics, roc_auc, roc_points,
    confusion_matrix, accuracy_by_prob_bin, reliability_points, null_summary, class_counts, phase_vs_baseline, ot_parse, stake_sizing, ask_walk, season_expand, prompt_text,
    coerce_numeric, fill_winner, union_reindex, sort_nulls_last, schedule_parse, required_nulls, events_by_hour,
]
