"""Word patterns and label sets that results depend on. First match wins where order is said to matter."""

# Action families with the patterns that name them, in order of precedence.
ACTION_FAMILIES = (
    ("Replace", (r"replac", r"\brenew", r"\bswap", r"\bchang(e|ed|ing)", r"\binstall", r"remov(e|ed|al).*(replac|install|new)", r"\bnew\b")),
    ("Calibrate", (r"calibrat", r"\brig\b", r"\brigg", r"\btime[d]?\b", r"\bre-?time", r"synchron")),
    ("Inspect", (r"inspect", r"borescop", r"\bvisual", r"examin", r"\bcheck(ed|ing)?\b.*(crack|wear|condition|security)", r"\ble?a?k check")),
    ("Diagnose", (r"diagnos", r"troubleshoot", r"\btest", r"\bcheck", r"measure", r"\bconfirm", r"verif", r"evaluat", r"analy[sz]", r"ground run", r"run.?up", r"\bfound\b", r"\btrace", r"isolat", r"duplicat")),
    ("Adjust", (r"adjust", r"\balign", r"\bgap", r"torque", r"tighten", r"clearance", r"\bset\b", r"reposition", r"secur")),
    ("Service", (r"servic", r"clean", r"lubricat", r"\blube", r"greas", r"drain", r"refill", r"\bfill", r"bleed", r"flush", r"safet(y|ie)", r"lock.?wire", r"seal(ed|ing)?\b", r"paint", r"apply", r"treat")),
    ("Repair", (r"repair", r"weld", r"reswedg", r"resweg", r"patch", r"overhaul", r"rebuild", r"reseat", r"restor", r"fabricat", r"\bfix", r"rework", r"reglu")),
)
DIAGNOSTIC_FAMILIES = ("Inspect", "Diagnose")

# Fault families with the patterns that name them, in order of precedence.
ISSUE_FAMILIES = (
    ("leak", (r"leak", r"seep", r"weep")),
    ("crack", (r"crack", r"fractur", r"split")),
    ("wear", (r"\bworn", r"\bwear\b", r"eroded", r"pitt", r"scor(e|ed|ing)", r"galled")),
    ("loose", (r"loose", r"\bplay\b", r"backlash", r"wobbl")),
    ("corrosion", (r"corro", r"rust", r"oxidi")),
    ("burnt", (r"burn", r"scorch", r"charred", r"overheat", r"\bhot\b")),
    ("broken", (r"broke", r"\bbroken", r"snapp", r"separat", r"fail", r"\bbent", r"deform", r"collaps")),
    ("low compression", (r"low compress", r"no compress", r"lost compress", r"weak cylinder")),
    ("rough running", (r"rough", r"misfir", r"miss(ing|es|ed)?\b", r"backfir", r"surg", r"sputter", r"stumbl", r"hesitat")),
    ("vibration", (r"vibrat", r"shak", r"shudder")),
    ("power loss", (r"power loss", r"los(e|es|ing|t) power", r"low power", r"partial power", r"won.?t make power")),
    ("will not start", (r"won.?t start", r"will not start", r"no start", r"hard start", r"fail.*start", r"crank.*no")),
    ("quit / shutdown", (r"\bquit", r"shut ?down", r"died", r"cut ?out", r"stall")),
    ("noise", (r"noise", r"nois", r"knock", r"grind", r"squeal", r"clunk", r"tick")),
    ("smoke", (r"smok",)),
    ("contamination", (r"contaminat", r"debris", r"metal", r"blocked", r"clog", r"restrict", r"plugged")),
    ("chafing", (r"chaf", r"rub", r"fray")),
    ("stuck / binding", (r"stuck", r"seiz", r"bind", r"jam", r"frozen")),
    ("inoperative", (r"inop", r"inoperativ", r"no output", r"not work", r"dead", r"intermittent", r"erratic", r"fluctuat")),
    ("missing / damaged", (r"missing", r"damag", r"\bhole", r"punctur", r"\btorn", r"\bnick", r"gouge", r"dent")),
    ("high reading", (r"\bhigh\b", r"excessive", r"over ?temp", r"over ?press")),
    ("low reading", (r"\blow\b", r"insufficient", r"\bweak\b")),
)

# Signs of a good and of a bad outcome.
GOOD_OUTCOME = (
    r"\bgood\b", r"\bok\b", r"okay", r"satisfactor", r"serviceable", r"no defect", r"no leak", r"no further", r"correct(ed|ly)?\b", r"resolv", r"\brepaired\b",
    r"operational", r"within limit", r"\bnormal\b", r"complet", r"signed off", r"return.*service", r"ops? ?check.*good", r"ground.?check.*good", r"leak ?check.*good",
    r"check.*good", r"\bpass", r"functions? ?normal",
)
BAD_OUTCOME = (
    r"\bstill\b", r"could not", r"couldn.?t", r"unable", r"unresolv", r"persist", r"no effect", r"not duplicat", r"cannot duplicat", r"could not duplicat",
    r"\bfail", r"defer", r"inop", r"recurr", r"replace again", r"no improve", r"worse",
)
OUTCOME_ORDER = ("positive", "unknown", "negative", "mixed")

# Designators of position and their canonical forms.
LOCATION = r"\b(#\s?\d+|no\.?\s?\d+|number\s?\d+|cyl(?:inder)?\s?\d+|l\.?h\.?|r\.?h\.?|left|right|front|rear|fwd|forward|aft|upper|lower|inboard|outboard|top|bottom|nose|tail|port|starboard)\b"
LOCATION_FORMS = {"lh": "left", "l.h.": "left", "rh": "right", "r.h.": "right", "fwd": "forward", "port": "left", "starboard": "right"}

# Relation types with the entity types that may be their head and tail.
SIGNATURES = (
    ("HAS_PART", ("MAINT_ITEM",), ("MAINT_ITEM",)),
    ("ISSUE_ON_ITEM", ("FAULT", "ABN_PROC"), ("MAINT_ITEM",)),
    ("ACTION_ON_ITEM", ("ACTION",), ("MAINT_ITEM",)),
    ("OBSERVATION_OF_ITEM", ("TECH_OBS",), ("MAINT_ITEM",)),
    ("HAS_LOCATION", ("MAINT_ITEM", "FAULT", "ABN_PROC"), ("LOC",)),
    ("OCCURS_UNDER_CONTEXT", ("FAULT", "ABN_PROC", "ACTION"), ("OP_CTX",)),
    ("ACTION_ADDRESSES_ISSUE", ("ACTION",), ("FAULT", "ABN_PROC")),
    ("ACTION_INVESTIGATES_ISSUE", ("ACTION",), ("FAULT", "ABN_PROC")),
    ("ACTION_USES_ITEM", ("ACTION",), ("MAINT_ITEM",)),
    ("ACTION_RESULTS_IN_OUTCOME", ("ACTION",), ("OUTCOME",)),
    ("ACTION_FOLLOWS_REFERENCE", ("ACTION",), ("REFERENCE",)),
)

# What a normalizer may not lose: identifiers, measurements, directions and negations.
PROTECTED = (
    r"\b[A-Z]{1,5}[-/]?\d[A-Z0-9./-]*\b",
    r"\b\d+(?:\.\d+)?\s?(?:V|A|PSI|PSIG|IN|MM|CM|NM|LB|LBS|HR|HRS|MIN|SEC|DEG|°C|°F)\b",
    r"\b(?:LEFT|RIGHT|LH|RH|NO|NOT|NEVER)\b",
)

# Beginnings in the past tense and their imperative.
IMPERATIVES = (("removed", "Remove"), ("replaced", "Replace"), ("installed", "Install"), ("inspected", "Inspect"), ("adjusted", "Adjust"), ("cleaned", "Clean"), ("repaired", "Repair"), ("tightened", "Tighten"), ("lubricated", "Lubricate"), ("calibrated", "Calibrate"), ("checked", "Check"), ("tested", "Test"), ("serviced", "Service"), ("drained", "Drain"))

# Number words.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")

# Weights of the structural channel (components, faults, entity types, relation types) and of the mixed score.
STRUCTURE_WEIGHTS = (0.40, 0.30, 0.15, 0.15)
MIX_WEIGHTS = {"bm25": 0.34, "word": 0.24, "char": 0.14, "struct": 0.28}
TEXT_WEIGHTS = {"bm25": 0.5, "word": 0.3, "char": 0.2}
