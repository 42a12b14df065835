"""Fixed values shared by the operators.

Distances are pitch units (x in [-1, 1], y in [-0.42, 0.42]) or metres, times are frames at
25 per second. Operators take ``unit``: how many stored units make one pitch unit (1 for
float traces, 1000 for integer milli-unit traces). Thresholds are scaled by it.
"""

# --- fixed values: clip geometry ---
FPS = 25
CLIP_FRAMES = 125
VISIBLE_FRAMES = 25
MARK_FRAMES = 8
STRIDE = 5
SKIP_START = 25
FRAME_W, FRAME_H = 1280, 480
GRID_COLS, GRID_ROWS = 16, 6
METRES_X, METRES_Y = 52.5, 34.0 / 0.42
WORLD_X, WORLD_Y = 54.4, -83.6

# --- fixed values: game modes and names ---
NORMAL, KICKOFF, GOALKICK, FREEKICK, CORNER, THROWIN, PENALTY = range(7)
SET_PIECES = (1, 2, 3, 4, 5, 6)
MODE_NAMES = {0: "normal", 1: "kickoff", 2: "goalkick", 3: "freekick",
              4: "corner", 5: "throwin", 6: "penalty"}
KIND_NAMES = {"corner": "corner kick", "gk_throw": "goalkeeper distribution",
              "kickoff": "kick-off", "open": "open play"}
TEAM_COLOURS = {0: "blue", 1: "red", -1: "loose"}
SLOT_ROLES = ["GK", "RM", "CF", "LB", "CB", "CB", "RB", "CM", "CM", "CM", "LM"]
OUTFIELD_RGB = {0: (28, 72, 224), 1: (214, 32, 32)}

# --- fixed values: continuity and engagement gates ---
TELEPORT = 0.35
GOAL_LINE, GOAL_HALF = 1.0, 0.05
ENGAGEMENT = {  # kind: loose_max, apex_max, dnear_max, path_min, path_max
    "open": (0.55, 2.60, 3.50, 0.33, 0.95),
    "corner": (0.85, 3.60, 4.00, 0.25, 1.20),
    "gk_throw": (0.65, 5.20, 4.00, 0.25, 1.20),
    "kickoff": (0.60, 3.00, 4.00, 0.25, 1.10),
    "header": (0.60, 3.20, 4.00, 0.25, 1.20),
}
LEAD = {"corner": 10, "kickoff": 10, "gk_throw": 38, "open": 0}
SLIDE = {"corner": 50, "kickoff": 50, "gk_throw": 50}
CLASS_ORDER = ["corner", "gk_throw", "kickoff", "open"]
MAX_WINDOWS, MIN_SEPARATION = 40, 25
NEAR_RADIUS = 0.06

# --- fixed values: batch design ---
LEVELS = list(range(8, 20))
PER_LEVEL = 2
CLASS_QUOTA = {"corner": 5, "gk_throw": 5, "kickoff": 5, "open": 9}
SPREAD_WEIGHT = 0.06
SPREAD_CELL, SPREAD_ROW, SPREAD_COLUMN = 3.0, 0.25, 0.12
KEPT_BONUS = 100.0
PROBE_BUDGET = {"corner": 999, "gk_throw": 18, "kickoff": 16, "open": 26}
MAX_END = 1900
SCARCE = ("corner", "gk_throw")
OFFSET_X_SCHEDULE = [0.0, -12.0, 12.0, -20.0, 20.0, -6.0, 6.0, -24.0, 24.0, -16.0, 16.0]
OFFSET_Y_SCHEDULE = [0.0, 6.0, -5.0, 10.0, -9.0, 3.0, -2.0, 8.0, -7.0]
SHAPES = ["mid_bal", "mid_even", "mid_even2", "mid_push", "mid_r", "flankL", "flankL2",
          "flankR", "boxL", "boxR", "wideL", "wideR", "countL", "countR"]
SHAPE_ALIASES = {"mid_even": "mid_bal", "mid_even2": "mid_bal"}

# --- fixed values: camera calibration ---
PX_PER_OFFSET_X = -26.58
CROSS_TERM = -2.92
CAL_DPY = [-228.3, -188.7, -168.0, -124.2, -77.3, -39.8, 0.0, 42.2, 87.4, 135.7, 187.0]
CAL_OFFY = [-20.0, -16.0, -14.0, -10.0, -6.0, -3.0, 0.0, 3.0, 6.0, 9.0, 12.0]
OFFSET_X_RANGE, OFFSET_Y_RANGE = (-26.0, 26.0), (-12.0, 12.0)
SAFE_PX, SAFE_PY = (55.0, 1225.0), (35.0, 445.0)
ENVELOPE_X, ENVELOPE_Y = 55.0 * 0.95 * 0.88, 36.0 * 0.80 * 0.88
