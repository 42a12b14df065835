"""The same derived views as plain SQL, and a helper that puts the needed ones in front."""
from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "lengths": "SELECT CAST(l_suppkey AS BIGINT) AS match_id, count(*) AS n FROM lineitem "
               "GROUP BY 1",
    "frames": """SELECT CAST(l_suppkey AS BIGINT) AS match_id, row_number() OVER (PARTITION BY
        l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS frame FROM lineitem""",
    "phases": """SELECT match_id, frame, match_id AS play FROM frames""",
    "legs": """SELECT *, (frame+37*play)%173 AS ph, ((frame+37*play)//173)%3 AS k,
        CASE WHEN ((frame+37*play)//519)%2=0 THEN 1 ELSE -1 END AS sg,
        (frame+11*play)%97 AS g, (frame+11*play)//97 AS gi,
        greatest(0,(frame+37*play)%173-12) AS q FROM phases""",
    "legs2": "SELECT *, CASE WHEN q<=78 THEN q ELSE 156-q END AS r FROM legs",
    "trace": """SELECT match_id, frame, play, ph, ball_x::BIGINT AS ball_x, ball_y::BIGINT AS ball_y,
        ball_z::BIGINT AS ball_z, owned_team::BIGINT AS owned_team,
        owned_player::BIGINT AS owned_player, game_mode::BIGINT AS game_mode, score_l, score_r
        FROM rawtrace""",
    "rawtrace": """SELECT match_id, frame, play, ph,
        CASE k WHEN 0 THEN sg*(990-3*r) WHEN 1 THEN sg*(3*r-300) ELSE sg*3*r END AS ball_x,
        CASE k WHEN 0 THEN 410-2*q WHEN 1 THEN 2*q-150 ELSE 2*q END AS ball_y,
        CASE WHEN g BETWEEN 40 AND 55 THEN 1300 ELSE
          abs(((37*frame+53*play)%(3000+600*(play%6)))-(1500+300*(play%6))) END AS ball_z,
        CASE WHEN g BETWEEN 40 AND 55 THEN gi%2 WHEN ((frame+3*play)//9)%(2+play%4)=1 THEN -1
          ELSE ((frame+3*play)//18)%2 END AS owned_team,
        CASE WHEN g BETWEEN 40 AND 55 THEN 0 WHEN ((frame+3*play)//9)%(2+play%4)=1 THEN -1
          ELSE 1+((frame+play)//7)%10 END AS owned_player,
        CASE WHEN ph<14 AND k=0 THEN 4 WHEN ph<14 AND k=1 THEN 3 ELSE 0 END AS game_mode,
        CAST(sum(CASE WHEN k=2 AND ph=0 AND frame>0 AND sg=1 THEN 1 ELSE 0 END) OVER
          (PARTITION BY match_id ORDER BY frame) AS BIGINT) AS score_l,
        CAST(sum(CASE WHEN k=2 AND ph=0 AND frame>0 AND sg=-1 THEN 1 ELSE 0 END) OVER
          (PARTITION BY match_id ORDER BY frame) AS BIGINT) AS score_r
        FROM legs2""",
    "players": """SELECT match_id, frame, team, slot, ball_x, ball_y,
        CASE WHEN owned_team=team AND owned_player=slot THEN ball_x+5
          WHEN slot=0 THEN (2*team-1)*950 ELSE (2*team-1)*(50+70*slot-3*ph) END AS x,
        CASE WHEN owned_team=team AND owned_player=slot THEN ball_y+5
          WHEN slot=0 THEN 0 ELSE (97*slot+13*play)%801-400 END AS y
        FROM trace, (SELECT unnest(range(0,2)) AS team), (SELECT unnest(range(0,11)) AS slot)""",
    "bodies": """SELECT match_id, frame, min(sqrt((x-ball_x)*52.5*((x-ball_x)*52.5)
          + (y-ball_y)*(34.0::DOUBLE/0.42::DOUBLE)*((y-ball_y)*(34.0::DOUBLE/0.42::DOUBLE)))/1000.0::DOUBLE) AS near_m,
        min((x-ball_x)*(x-ball_x)+(y-ball_y)*(y-ball_y)) AS near2,
        count(*) FILTER ((x-ball_x)*(x-ball_x)+(y-ball_y)*(y-ball_y) < 3600) AS near_n,
        count(*) FILTER ((x-ball_x)*(x-ball_x)+(y-ball_y)*(y-ball_y) < 16900) AS near_wide,
        count(*) FILTER (team=0 AND x<0) AS left_home,
        count(*) FILTER (team=1 AND x>0) AS right_home
        FROM players GROUP BY match_id, frame""",
    "steps": """SELECT t.*, sqrt(((ball_x - lag(ball_x) OVER w)*(ball_x - lag(ball_x) OVER w)
          + (ball_y - lag(ball_y) OVER w)*(ball_y - lag(ball_y) OVER w))::DOUBLE) AS step,
        sqrt(((lead(ball_x) OVER w - ball_x)*(lead(ball_x) OVER w - ball_x)
          + (lead(ball_y) OVER w - ball_y)*(lead(ball_y) OVER w - ball_y))::DOUBLE) AS step_next,
        game_mode BETWEEN 1 AND 6 AND game_mode <> coalesce(lag(game_mode) OVER w, game_mode)
          AS award,
        abs(ball_x)>1000 AND abs(ball_y)<50 AS goal_touch
        FROM trace t WINDOW w AS (PARTITION BY match_id ORDER BY frame)""",
    "named": """SELECT match_id, shape, 300 + match_id//14 AS seed,
        shape || '_s' || lpad(CAST(300 + match_id//14 AS VARCHAR), 3, '0') AS match FROM (
        SELECT match_id, (['mid_bal','mid_even','mid_even2','mid_push','mid_r','flankL','flankL2',
        'flankR','boxL','boxR','wideL','wideR','countL','countR'])[match_id%14+1] AS shape
        FROM lengths)""",
    "inshot": """SELECT match_id, frame, slot, greatest(0, abs(((3*frame+29*match_id+71*slot)%300)
        -150)-15*(match_id%6)) AS body_px, (match_id+slot)%7 AS shadow_px
        FROM frames, (SELECT unnest(range(0,22)) AS slot)""",
    "ballpix": """SELECT match_id, frame, (389*match_id+17*frame+211)%1280 AS px,
        (157*match_id+7*frame+97)%480 AS py FROM frames WHERE (frame+match_id)%11<>0""",
    "absent": """SELECT match_id, (41*match_id)%500 AS lo, (41*match_id)%500+30 AS hi
        FROM lengths""",
    "truth": """SELECT match_id AS clip, (389*match_id+211)%1280 AS px,
        (157*match_id+97)%480 AS py FROM lengths""",
    "answers": r"""SELECT event_id, model, clip, CASE event_id%6
        WHEN 0 THEN 'Reasoning: run forward.' || chr(10) || 'Ball position: ' || rl || cn
        WHEN 1 THEN 'Ball position: ' || rl || ', ' || cn
        WHEN 2 THEN 'Ball position: row ' || rl || ' column ' || cn
        WHEN 3 THEN 'ball position: ' || (event_id%9) || ', ' || cn
        WHEN 4 THEN 'I think it is near ' || rl || cn || ' or B2'
        ELSE 'ERROR: timeout' END AS raw FROM (
        SELECT CAST(event_id AS BIGINT) AS event_id, event_type AS model,
        event_id % (SELECT count(*) FROM lengths) AS clip,
        chr(CAST(65+(7*event_id)%8 AS INTEGER)) AS rl, CAST((11*event_id)%18+1 AS VARCHAR) AS cn
        FROM events)""",
    "rollouts": """SELECT o_orderpriority AS level, CAST(o_orderkey AS BIGINT) AS seed,
        CASE WHEN o_custkey%5=0 THEN 1 ELSE 0 END AS "left",
        CASE WHEN o_custkey%7=0 THEN 1 ELSE 0 END AS "right",
        o_orderstatus<>'P' AS natural_end FROM orders""",
    "pixels": """SELECT clip, y, x, CASE WHEN lit THEN 230 ELSE gr END AS vis_r,
        CASE WHEN lit THEN 228 ELSE gr+40 END AS vis_g, CASE WHEN lit THEN 226 ELSE gr-5 END
        AS vis_b, gr AS inv_r, gr+40 AS inv_g, gr-5 AS inv_b FROM (
        SELECT clip, y, x, 20+((7*x+13*y+3*clip)%30) AS gr,
        abs(x-px//20)<=1 AND abs(y-py//20)<=1 AS lit
        FROM truth, (SELECT unnest(range(0,24)) AS y), (SELECT unnest(range(0,64)) AS x))""",
}


def slot_sql(team: str, slot: str) -> tuple[str, str]:
    """x and y of one player of a row of `trace`, without unfolding all 22."""
    own = f"CASE WHEN owned_team={team} AND owned_player={slot} THEN"
    return (f"({own} ball_x+5 WHEN {slot}=0 THEN (2*({team})-1)*950 ELSE (2*({team})-1)*(50+70*({slot})-3*ph) END)",
            f"({own} ball_y+5 WHEN {slot}=0 THEN 0 ELSE (97*({slot})+13*play)%801-400 END)")


def with_views(body: str, **extra: str) -> str:
    """Prefix ``body`` with the views it mentions, directly or through other views.

    ``extra`` adds views local to one query; they may replace a shared one.
    """
    views = {**VIEWS, **extra}
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"[a-z_0-9]+", sql)):
            if word in views and word not in needed:
                needed.add(word)
                visit(views[word])
    visit(body)

    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for word in re.findall(r"[a-z_0-9]+", views[name]):
            if word in needed and word != name:
                place(word)
        order.append(name)
    for name in views:
        if name in needed:
            place(name)
    recursive = "RECURSIVE " if any("UNION ALL" in views[n] and re.search(rf"FROM {n}\b", views[n])
                                    for n in order) else ""
    heads = ",\n".join(f"{n} AS MATERIALIZED ({views[n]})" if n in (
        "trace", "bodies", "steps") else f"{n} AS ({views[n]})" for n in order)
    return f"WITH {recursive}{heads}\n{body}" if order else body
