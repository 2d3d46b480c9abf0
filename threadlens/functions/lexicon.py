"""Default word lists for the lexicon sentiment job.

The full published lexicon (about 7.5k rated terms) is not shipped; the
lexicon is a ``(term string, valence double)`` table argument. Booster and
negation lists below follow the published rule-based model (Hutto &
Gilbert, 2014) and can be overridden per call.
"""

# Rule constants of the lexicon model.
BOOST_INCR = 0.293
BOOST_DECR = -0.293
CAPS_INCR = 0.733
NEGATION_SCALAR = -0.74
EXCLAIM_STEP = 0.292
EXCLAIM_MAX = 4
QUESTION_STEP = 0.18
QUESTION_MAX = 0.96
NORMALIZE_ALPHA = 15.0

# Intensity boosters (increase).
BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably",
    "decidedly", "deeply", "effing", "enormous", "enormously", "entirely", "especially",
    "exceptional", "exceptionally", "extreme", "extremely", "fabulously", "flipping",
    "flippin", "frackin", "fracking", "fricking", "frickin", "frigging", "friggin", "fully",
    "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely",
    "incredible", "incredibly", "intensely", "major", "majorly", "more", "most",
    "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
    "thoroughly", "total", "totally", "tremendous", "tremendously", "uber", "unbelievably",
    "unusually", "utter", "utterly", "very",
]
# Intensity dampeners (decrease).
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of",
    "less", "little", "marginal", "marginally", "occasional", "occasionally", "partly",
    "scarce", "scarcely", "slight", "slightly", "somewhat", "sort of", "sorta", "sortof",
    "sort-of",
]
# Negation words ("n't" anywhere in a word also negates).
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]

# Idioms of the published model (phrase -> valence), checked around
# a lexicon word together with its third-predecessor rule.
IDIOMS = [
    ("the shit", 3.0), ("the bomb", 3.0), ("bad ass", 1.5), ("badass", 1.5), ("bus stop", 0.0),
    ("yeah right", -2.0), ("kiss of death", -1.5), ("to die for", 3.0), ("beating heart", 3.1),
    ("broken heart", -2.9),
]

# A small hand-authored default lexicon (term, valence on -4..4).
DEFAULT_LEXICON = [
    ("good", 1.9), ("great", 3.1), ("excellent", 2.7), ("happy", 2.7), ("love", 3.2),
    ("like", 2.0), ("nice", 1.8), ("best", 3.2), ("better", 1.9), ("helpful", 1.8),
    ("relief", 1.7), ("calm", 1.3), ("hope", 1.9), ("thanks", 1.9), ("glad", 2.0),
    ("bad", -2.5), ("worse", -2.1), ("worst", -3.1), ("hate", -2.7), ("sad", -2.1),
    ("pain", -2.3), ("awful", -2.0), ("terrible", -2.1), ("anxious", -1.0), ("angry", -2.3),
    ("tired", -1.9), ("sick", -2.3), ("fear", -2.2), ("hurt", -2.4), ("no", -1.2),
]
