"""Types and fixed values of the pitch data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values: outcomes, codes and labels of the pitch feed --------------------------------
#: Outcomes that count as an at bat.
AB_EVENTS = ("single", "double", "triple", "home_run", "field_out", "strikeout", "grounded_into_double_play", "double_play", "force_out", "fielders_choice", "fielders_choice_out", "strikeout_double_play", "triple_play", "field_error")
#: Plate appearances: at bats and these.
PA_EVENTS = AB_EVENTS + ("walk", "hit_by_pitch", "sac_fly", "sac_bunt", "sac_fly_double_play", "catcher_interf", "intent_walk")
HIT_EVENTS = ("single", "double", "triple", "home_run")
WALK_EVENTS = ("walk", "intent_walk")

#: Pitch types of the wide arsenal table, in its column order.
PITCH_TYPES = ("CH", "CS", "CU", "EP", "FA", "FC", "FF", "FO", "FS", "KC", "KN", "PO", "SC", "SI", "SL", "ST", "SV", "UN")
ARSENAL_METRICS = ("usage_pct", "avg_speed", "avg_spin", "whiff_rate", "avg_pfx_x", "avg_pfx_z")
PITCH_NAMES = {"FF": "Four-seam FB", "SI": "Sinker", "FC": "Cutter", "SL": "Slider", "CU": "Curveball", "KC": "Knuckle Curve", "CH": "Changeup", "FS": "Splitter", "ST": "Sweeper", "SV": "Slurve", "EP": "Eephus", "KN": "Knuckleball", "SC": "Screwball", "FO": "Forkball", "CS": "Slow Curve", "PO": "Pitchout"}

#: File prefix: country code and name.
SOURCE_COUNTRIES = {
    "usa": ("USA", "USA"), "japan": ("JPN", "Japan"), "dr": ("DOM", "Dominican Republic"), "venezuela": ("VEN", "Venezuela"),
    "pr": ("PUR", "Puerto Rico"), "mex": ("MEX", "Mexico"), "kor": ("KOR", "Korea"), "twn": ("TPE", "Chinese Taipei"),
    "ned": ("NED", "Netherlands"), "cuba": ("CUB", "Cuba"), "can": ("CAN", "Canada"), "ita": ("ITA", "Italy"),
    "isr": ("ISR", "Israel"), "gb": ("GBR", "Great Britain"), "pan": ("PAN", "Panama"), "col": ("COL", "Colombia"),
    "nic": ("NCA", "Nicaragua"), "aus": ("AUS", "Australia"), "bra": ("BRA", "Brazil"), "cze": ("CZE", "Czechia"),
}
#: Country name in a roster's header: code.
ROSTER_COUNTRIES = {
    "USA": "USA", "Japan": "JPN", "Dominican Rep.": "DOM", "Venezuela": "VEN", "Puerto Rico": "PUR", "Mexico": "MEX", "Korea": "KOR",
    "Chinese Taipei": "TPE", "Netherlands": "NED", "Cuba": "CUB", "Canada": "CAN", "Italy": "ITA", "Israel": "ISR", "Great Britain": "GBR",
    "Panama": "PAN", "Colombia": "COL", "Nicaragua": "NCA", "Australia": "AUS", "Brazil": "BRA", "Czechia": "CZE",
}
POOL_CITIES = {"サンフアン": "San Juan", "ヒューストン": "Houston", "東京ドーム": "Tokyo", "マイアミ": "Miami"}
#: Roster text: what parts a header line, what its second part begins with and the letters after that; lines to skip by how they begin; the line of column titles.
ROSTER_DASH, ROSTER_POOL, ROSTER_LETTERS = "—", "プール", "ABCD"
ROSTER_SKIPPED = ("WBC 2026", "出典")
ROSTER_TITLES = "選手名,"
#: Positions of pitchers.
PITCHER_POSITIONS = ("RHP", "LHP")
#: Team texts of players without a team: mark, label without and with a former team; and the sign before that team.
TEAM_STATUSES = (("FA", "Free Agent", "FA"), ("引退復帰", "Returning from retirement", "Returning from retirement"))
FORMER_SIGN = "前"
#: Team names as rosters give them.
TEAMS = {
    "アスレチックス": "Athletics", "アトランタ・ブレーブス": "Atlanta Braves", "アリゾナ・ダイヤモンドバックス": "Arizona Diamondbacks",
    "カンザスシティ・ロイヤルズ": "Kansas City Royals", "クリーブランド・ガーディアンズ": "Cleveland Guardians", "コロラド・ロッキーズ": "Colorado Rockies",
    "サンディエゴ・パドレス": "San Diego Padres", "サンフランシスコ・ジャイアンツ": "San Francisco Giants", "シアトル・マリナーズ": "Seattle Mariners",
    "シカゴ・カブス": "Chicago Cubs", "シカゴ・ホワイトソックス": "Chicago White Sox", "シンシナティ・レッズ": "Cincinnati Reds",
    "セントルイス・カージナルス": "St. Louis Cardinals", "タンパベイ・レイズ": "Tampa Bay Rays", "テキサス・レンジャーズ": "Texas Rangers",
    "デトロイト・タイガース": "Detroit Tigers", "トロント・ブルージェイズ": "Toronto Blue Jays", "ニューヨーク・メッツ": "New York Mets",
    "ニューヨーク・ヤンキース": "New York Yankees", "ヒューストン・アストロズ": "Houston Astros", "ピッツバーグ・パイレーツ": "Pittsburgh Pirates",
    "フィラデルフィア・フィリーズ": "Philadelphia Phillies", "ボストン・レッドソックス": "Boston Red Sox", "ボルティモア・オリオールズ": "Baltimore Orioles",
    "マイアミ・マーリンズ": "Miami Marlins", "ミネソタ・ツインズ": "Minnesota Twins", "ミルウォーキー・ブルワーズ": "Milwaukee Brewers",
    "ロサンゼルス・エンゼルス": "Los Angeles Angels", "ロサンゼルス・ドジャース": "Los Angeles Dodgers", "ワシントン・ナショナルズ": "Washington Nationals",
    "オリオールズ": "Orioles", "ヤンキース": "Yankees", "ドジャース": "Dodgers",
}
#: Measures of a bat-tracking pitch table.
BAT_MEASURES = ("bat_speed", "swing_length", "swing_path_tilt", "attack_angle", "attack_direction")

#: Leaderboards: board, metric, ascending, rows, season column.
LEADERBOARDS = (
    ("bat_tracking", "avg_bat_speed", False, 20, "year"), ("pitch_tempo", "median_seconds_empty", True, 20, "year"),
    ("arm_strength", "max_arm_strength", False, 20, "year"), ("home_runs", "no_doubters", False, 20, "year"),
    ("swing_take", "runs_all", False, 20, "year"), ("running_game", "runs_prevented_on_running_attr", False, 20, "year"),
    ("catcher_blocking", "blocks_above_average", False, 15, "year"), ("catcher_throwing", "pop_time", True, 15, "year"),
    ("catcher_throwing", "caught_stealing_above_average", False, 15, "year"), ("baserunning", "runner_runs_tot", False, 20, "year"),
    ("basestealing", "runs_stolen_on_running_act", False, 20, "year"), ("timer_infractions", "all_violations", False, 20, "year"),
    ("outs_above_average", "outs_above_average", False, 20, "year"), ("outs_above_average", "outs_above_average", True, 20, "year"),
    ("outfield_jump", "rel_league_bootup_distance", False, 20, "year"), ("park_factors", "pf_5yr", True, 30, "season"),
    ("pitcher_quality", "pitching_plus", False, 20, "season"),
)
STUFF_LABELS = {"stuff_fa": "4-Seam FB", "stuff_si": "Sinker", "stuff_fc": "Cutter", "stuff_sl": "Slider", "stuff_cu": "Curveball", "stuff_ch": "Changeup", "stuff_st": "Sweeper", "stuff_fs": "Splitter"}
# ---- End of fixed values ------------------------------------------------------------------------

PITCHES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("game_pk", "pitcher", "batter")]
    + [T.StructField(n, T.IntegerType()) for n in ("at_bat_number", "pitch_number", "season", "balls", "strikes", "inning", "zone")]
    + [T.StructField("game_date", T.DateType())]
    + [T.StructField(n, T.StringType()) for n in ("player_name", "pitch_type", "events", "description", "stand", "country", "country_name")]
    + [T.StructField(n, T.DoubleType()) for n in ("release_speed", "release_spin_rate", "pfx_x", "pfx_z", "plate_x", "plate_z", "sz_top", "sz_bot", "hc_x", "hc_y", "launch_speed", "launch_angle", "estimated_woba_using_speedangle", *BAT_MEASURES)]
)
ROSTER = T.StructType([T.StructField(n, T.BooleanType() if n == "on_40_man" else T.StringType()) for n in ("name", "country", "pool", "position", "team", "on_40_man", "role")])
