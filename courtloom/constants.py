"""Fixed values of the domain: court model, frame clock, thresholds and vocabularies.

These are plain facts about the data (a rule set, a court, a rig). They must not be tuned per query.
"""

# --- frame clock -------------------------------------------------------------------------------
FPS = 29.97
CAMERAS = ("FL", "FR", "NL", "NR")
FAR_CAMERAS = ("FL", "FR")
CHUNK_SECONDS = 600
CHUNK_FRAMES = 17982            # 600 s of frames: the bound on every chunk-keyed group
BLOCK_FRAMES = 17982            # width of an ordering block (see operators/ordered.py)

# --- court (cm) ----------------------------------------------------------------------------------
COURT_LENGTH = 2143.7
COURT_WIDTH = 1426.4
COURT_CENTER_X = COURT_LENGTH / 2
BASKET_L = (107.7, 713.2)
BASKET_R = (2036.0, 713.2)
ZONE_BOUNDS = (710.0, 840.0)    # calibrated 2PT/3PT and 3PT/4PT release distances
THREE_PT_RADIUS = 670.6
FOUR_PT_RADIUS = {"L": 949.5, "R": 939.8}
FT_BAND = (430.0, 610.0)
COURT_PAD = 300.0
HULL_PAD = 250.0

# --- possession ---------------------------------------------------------------------------------
HOLD_D = 0.7
SWITCH_K = 6
CATCH_K = 3
FLIGHT_V = 14.0
SINCE_FLIGHT = 4
HYSTERESIS_K = 8
SUSTAIN_F = 10
POSSESS_EXPAND = 1.35
VOTE_DIST = 2.0
POSS_RADIUS = 180.0
STICKY_MARGIN = 70.0
LOOSE_CONFIRM = 3
MIN_POSS_FRAMES = 12
PASS_MAX_GAP = 30
FASTBREAK_CM = 800.0
FASTBREAK_S = 2.0
BOX_EXPAND = 0.20
NEAR_FRAC = 0.5

# --- ball ----------------------------------------------------------------------------------------
BALL_GATE_CM = 250.0
BALL_MAX_COAST = 12
BALL_REINIT_SCORE = 0.2
BALL_REINIT_FRAMES = 3
STATIONARY_CELL = 80.0
STATIONARY_OCC = 0.35
CLUSTER_CM = 200.0
AGREEMENT_BOOST = 0.6

# --- vocabularies --------------------------------------------------------------------------------
DETECTION_CLASSES = ("player", "referee", "ball")
RIM_CLASSES = ("basketball", "basketball hoop")
TEAM_NAMES = {"A": "Blue", "B": "Green"}
KIT_TEAM = {"B": 1, "W": 2}
IMAGE_SUFFIXES = ("jpg", "jpeg", "png")
