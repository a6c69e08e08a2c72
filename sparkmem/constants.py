"""Defaults and fixed values.

The values in the FIXED VALUES block must equal the behaviour being matched
(budgets, weights, thresholds, names and labels); they are listed plainly, in
their natural order. Prompts and sentences below it are this library's own.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------
WM_CHAR_BUDGET = 4000          # working-memory character budget
WM_HALF_LIFE_SECONDS = 900     # decay half-life
VECTOR_DIM = 256               # deterministic embedding dimension
TOPK_DEFAULT = 5               # default k for searches and task lists
CYCLE_RETRIEVAL_K = 8          # memories retrieved per cycle
LLM_CTX = 8192                 # context size in tokens; 4 characters per token
STIMULI_SHARE = 0.20
WM_SHARE = 0.30
LTM_SHARE = 0.50
RECENT_THOUGHTS_CAP = 100      # ring of recent thoughts
SCRAPER_MAX_PAGES = 5
SCRAPE_TEXT_CHARS = 4000
CONSOLIDATE_MAX_ITEMS = 50
CONSOLIDATE_THRESHOLD = 0.95
SUMMARY_CHARS = 512
COSINE_EPS = 1e-8
TASK_DAY_SECONDS = 86400.0
TASK_HOUR_SECONDS = 3600.0

# attention weights: urgency, importance, uncertainty, recency, goal fit
TASK_WEIGHTS = (0.35, 0.25, 0.15, 0.10, 0.15)

MEMORY_TYPES = ("episodic", "semantic", "procedural")
TASK_STATUSES = ("open", "doing", "done", "blocked")
THOUGHT_TAGS = ("#plan", "#question", "#insight")

STIMULUS_IMPORTANCE = 0.3
ANSWER_IMPORTANCE = 0.4
SCRAPED_IMPORTANCE = 0.2
QUESTION_RATIONALE = "Missing external info"
SUMMARY_PREFIX = "Summary of {n} events:\n"
EMPTY_STIMULI_QUERY = "general"
NO_SNIPPET = "the goal"
MAX_THOUGHT_WORDS = 60
STORE_THRESHOLD = 0.55

DECIDER_SYSTEM = "STORE_DECIDER:"
DECIDER_TAGS = ("plan", "question", "insight")
# ---------------------------------------------------------------------------

STIMULI_BUDGET = int(LLM_CTX * 4 * STIMULI_SHARE)   # 6553
WM_SUMMARY_BUDGET = int(LLM_CTX * 4 * WM_SHARE)     # 9830
LTM_BUDGET = int(LLM_CTX * 4 * LTM_SHARE)           # 16384

# 2**32 mod 900: folding a 256-bit hash 32 bits at a time into "seed mod 900"
SEED_MODULUS = 900

# Wording of this library: prompts, and the deterministic generator's three sentences per tag
# (picked by (seed // 5) % 3; {x} is the latest stimulus).
DEFAULT_SELF_SUMMARY = "A memory service that turns events into short notes."
CYCLE_SYSTEM = (
    "You write one short note about the context below. Start it with #plan, #question or #insight and stay "
    "under 60 words."
)
DECIDER_PROMPT = (
    "Should the following note be remembered for long? Reply with a JSON object that has the keys should_store "
    "(boolean), importance (0 to 1), type (episodic, semantic or procedural) and tags (a list).\n"
    "note: "
)
PROMPT_TAIL = "Write the note."
TEMPLATES = {
    "#plan": (
        "Write down what done means for '{x}', then do the smallest part of it today.",
        "List who is needed for '{x}' and agree on a date with each of them.",
        "Put '{x}' before everything that can wait until tomorrow.",
    ),
    "#question": (
        "Who would notice first if '{x}' went wrong?",
        "What would change our mind about '{x}'?",
        "When was '{x}' last checked, and against which record?",
    ),
    "#insight": (
        "'{x}' keeps coming back, so it deserves an owner.",
        "The cost of '{x}' lies in the waiting, not in the work.",
        "Two open points look like one cause behind '{x}'.",
    ),
}
