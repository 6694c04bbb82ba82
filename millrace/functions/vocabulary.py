"""Word lists, weights and patterns that decide results.  Fixed values."""

# Phrases that mark a document as relevant.
SIGNALS = (
    "adaptive control", "bode", "closed loop", "controllability", "controller", "discrete time", "dynamic system",
    "estimator", "feedback", "frequency response", "gain margin", "h infinity", "kalman", "laplace", "linear quadratic",
    "loop shaping", "lyapunov", "model predictive", "nyquist", "observability", "observer", "phase margin", "pid",
    "pole placement", "riccati", "robust control", "root locus", "state feedback", "state space",
    "system identification", "transfer function",
)

# Weights of phrases in catalogue records, by the best field that has them.
PHRASES = {
    "automatic control": 12, "control engineering": 12, "control system": 12, "feedback control": 12, "robust control": 12,
    "optimal control": 12, "model predictive control": 14, "predictive control": 11, "nonlinear control": 12,
    "adaptive control": 12, "digital control": 10, "process control": 10, "distributed control": 10, "networked control": 10,
    "sliding mode": 9, "system identification": 11, "state estimation": 10, "kalman filter": 10, "observer design": 10,
    "dynamical system": 8, "dynamic system": 7, "system theory": 8, "signals and systems": 10, "signal processing": 7,
    "mechatronics": 7, "robotics": 6, "autonomous system": 6, "trajectory optimization": 9, "convex optimization": 8,
    "numerical optimization": 7, "optimization algorithm": 5, "linear algebra": 6, "differential equation": 6,
    "numerical method": 5, "stochastic process": 6, "time series": 4, "mathematical modeling": 5, "mathematical modelling": 5,
}
FIELD_FACTORS = {"title": 3, "subjects": 2, "description": 1}

# Phrases that count against a record, and by how much each.
NEGATIVE = (
    "access control", "birth control", "disease control", "infection control", "pest control", "social control",
    "tobacco control", "crime control", "border control", "arms control",
)
PENALTY = 18

# File roles by path, in order; then by extension.
CODE_EXTENSIONS = (".m", ".py", ".ipynb")
USEFUL_EXTENSIONS = (".pdf", ".html", ".htm", ".m", ".py", ".ipynb", ".md", ".txt", ".srt", ".vtt")
ROLE_PATTERNS = (
    ("solution", r"((^|[/_.-])(sol|solution|solutions|answer|answers)([/_.-]|$)|(?:ps|hw|exam|quiz)\d*[_-]?sol)"),
    ("exam", r"(^|[/_.-])(exam|quiz|midterm|final|test)\d*([/_.-]|$)"),
    ("assignment", r"((^|[/_.-])(assignment|problem|problems|prob|pset|homework)\d*([/_.-]|$)|(^|[/_.-])(hw|ps)\d+([/_.-]|$))"),
    ("lecture", r"(^|[/_.-])(lecture|lectures|lec|chapter|chap|notes)([/_.-]|$)"),
    ("syllabus", r"(^|[/_.-])(syllabus|calendar|readings)([/_.-]|$)"),
    ("transcript", r"\.(srt|vtt)$"),
)

# Words that never name a source.
GENERIC_SOURCE_WORDS = (
    "control", "controls", "systems", "system", "engineering", "theory", "lecture", "lectures", "notes", "chapter",
    "solutions", "solution", "exercise", "exercises", "book", "textbook", "txtbk", "edition", "vol", "part", "final",
    "exam", "slides", "course", "intro", "introduction",
)
SOURCE_BOOST = 1.6

# Words of prompts that need a numeric tool.
TOOL_WORDS = (
    "plot", "simulate", "simulation", "compute", "calculate", "design", "solve", "gain", "matrix", "matrices", "pole",
    "place", "locus", "bode", "nyquist", "margin", "response", "transfer function", "eigen", "controllab", "observab",
    "lyapunov", "kalman", "mpc", "invert", "determinant", "transpose", "multiply", "rank", "code", "script",
)

# Cues of an answer that refuses or asks back.
REFUSAL_CUES = (
    "missing", "cannot", "specify", "please provide", "uncontrollable", "unobservable", "undefined", "invalid",
    "positive semi-definite", "zero control authority", "sampling period", "not possible", "cannot be inverted",
    "violates", "requires",
)

# File names that must not show in an answer.
RAW_FILE_NAME = r"(?i)\.pdf\b|\.md\b|\.jsonl?\b|\bJD_|\bB&B_|\bBBB[_\s]|\bLP_|\bEC_|\bAC_|\bFG_|\bRB_|\bXX_|txtbk|DEFINITIVO"

# Quality gate.
LEAST_TOKENS, LEAST_PRINTABLE, LEAST_ALPHABETIC, REPEATS, LEAST_WORDS = 80, 0.98, 0.35, 13, 25

# BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
