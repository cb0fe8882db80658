"""Fixed values that results depend on: thresholds, word lists, lookup tables."""

# Shot boundaries
MIN_CONTENT_VALUE = 0.055
ADAPTIVE_RATIO = 3.0
ROLLING_ROWS = 2
MIN_SHOT_SECONDS = 0.15
GRADUAL_MIN_VALUE = 0.016
DISSOLVE_RESIDUAL = 0.028
FLAT_LUMA_STD = 0.035
FADE_EXTREME_LUMA = 0.14
MAX_GRADUAL_SECONDS = 1.6
GRADUAL_ENDPOINT_DIFFERENCE = 0.06

# Confidence
TRUST_THRESHOLD = 0.55
DISPLAY_THRESHOLD = 0.30
CONFIDENCE_WEIGHTS = [("scenes", 0.40), ("motion", 0.25), ("audio", 0.20), ("text", 0.15)]

# Rec. 709 luma
LUMA_R, LUMA_G, LUMA_B = 0.2126, 0.7152, 0.0722

# Luma thumbnail size
THUMB_WIDTH, THUMB_HEIGHT = 24, 42

# Text
TEXT_GAP_SECONDS = 0.6
MIN_TEXT_CONFIDENCE = 0.35
MIN_TEXT_OBSERVATIONS = 2
WATERMARK_PHRASES = [
    "follow", "subscribe", "link in bio", "swipe up", "dm me",
    "tap here", "click link", "shop now at", "made with", "created with",
]
WATERMARK_HANDLE = r"(^|\s)@[a-z0-9._]{2,}"
CTA_KEYWORDS = [
    "dm", "order", "shop", "buy", "book", "call", "link", "swipe",
    "get yours", "available", "message", "whatsapp", "enquire", "visit",
]
LINE_BREAK = "\u2028"
ENTRY_SECONDS = {
    "none": 0.0, "fadeIn": 0.25, "popIn": 0.25, "slideUp": 0.30, "slideDown": 0.30,
    "wordByWord": 0.45, "typeOn": 0.45,
}
EXIT_SECONDS = {"none": 0.0, "fadeOut": 0.20, "popOut": 0.25, "slideDown": 0.25}

# Audio
SAMPLE_RATE = 22050.0
FFT_SIZE = 1024
HOP_SIZE = 512
ENVELOPE_RATE = SAMPLE_RATE / HOP_SIZE
ONSET_MEAN_ROWS = 15
MIN_LAG, MAX_LAG = 12, 43
TEMPO_PRIOR_BPM, TEMPO_PRIOR_SIGMA = 120.0, 0.42

# Assignment weights
WEIGHTS = {
    "framing": 1.0, "aesthetics": 0.8, "utility": 4.5, "aspect": 0.5, "kind": 0.35,
    "duration": 1.2, "reuse": 2.5, "adjacent": 1.5, "duplicate": 0.55, "softness": 0.45,
    "chronology": 0.3, "subject": 0.2,
}

# Audio mix
DUCK_LEVEL = 0.22
DUCK_RAMP = 0.30
CLIP_EDGE_FADE = 0.012
AUDIBLE_GAIN = 0.0005

# Quality
ACCEPTABLE_QUALITY = 0.55
LONG_STILL_SECONDS = 7.0

# Filter presets: id, exposure, contrast, saturation, temperature, vignette, grain
PRESETS = [
    ("none", 0.0, 1.0, 1.0, 0.0, 0.0, 0.0),
    ("warm", 0.04, 1.05, 1.10, 0.28, 0.0, 0.0),
    ("cool", 0.02, 1.06, 1.02, -0.26, 0.0, 0.0),
    ("vivid", 0.03, 1.18, 1.35, 0.05, 0.0, 0.0),
    ("soft", 0.08, 0.90, 0.94, 0.08, 0.15, 0.0),
    ("film", 0.02, 1.12, 0.88, 0.14, 0.28, 0.35),
    ("mono", 0.03, 1.22, 0.0, 0.0, 0.22, 0.20),
    ("fade", 0.10, 0.82, 0.82, 0.06, 0.10, 0.0),
    ("noir", -0.06, 1.40, 0.0, -0.05, 0.45, 0.30),
    ("bloom", 0.12, 0.95, 1.18, 0.18, 0.08, 0.0),
]

# Beats per cut before scaling, by music section
SECTION_BEATS = {"intro": 4.0, "build": 2.0, "peak": 1.0, "release": 3.0, "outro": 4.0, "steady": 2.0}

# Treatments: transition cycle of the "alternateTransitions" variation (kind, seconds, direction)
TRANSITION_CYCLE = [
    ("dissolve", 0.30, None), (None, None, None), ("push", 0.32, "left"), (None, None, None),
    ("slide", 0.30, "up"), ("zoomIn", 0.36, None), (None, None, None),
]

SCHEMA_VERSION = 1
