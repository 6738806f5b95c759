"""Word lists, patterns and prices that results depend on."""

# Stop words.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could "
    "i me my we our you your he him his she her it its they them their this that these those what which who whom "
    "and but or nor not so if then than of in on at to for with by from up about into through during before after "
    "above below between under over no yes all each every both few more other some such only own same too very "
    "just also how when where why here there out as"
).split()

# Suffixes of the stemmer, in order of trial.
DERIVED = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("iser", "ise"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("isation", "ise"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
ENDINGS = ["ement", "ment", "ness", "able", "ible", "ful", "less", "ance", "ence", "ity", "ive", "ous", "ize", "ise", "ate", "al"]

# Words of a question that show an intent, and the words that the intent adds.
NUMBER_WORDS = ["numerical", "number", "numbers", "results", "accuracy", "precision", "recall", "f1", "auc", "score", "scores", "metric", "metrics", "%"]
METHOD_WORDS = ["procedure", "working", "method", "methodology", "approach", "how", "pipeline", "architecture", "workflow", "algorithm", "steps", "process"]
RELATED_WORDS = ["related work", "related works", "previous work", "previous works", "prior work", "prior works", "literature", "literature review", "baseline", "state of the art", "sota"]
METHOD_EXTRA = ["proposed", "methodology", "pipeline", "architecture", "workflow", "procedure", "process", "steps", "preprocess", "implementation", "algorithm", "framework"]
RELATED_EXTRA = ["related", "work", "works", "prior", "previous", "literature", "baseline", "survey", "review", "et", "al", "proposed", "introduced"]

# Cues in a chunk.
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
METHOD_HEADING = r"(?i)\b(?:proposed methodology|methodology|approach|framework|workflow|pipeline|architecture|algorithm)\b"
STEP = r"(?i)\b(?:step\s*\d+|procedure|process|working|stages?)\b"
PROPOSED_METHOD = r"(?i)\b(?:iv\.\s*)?proposed\s+methodology\b"
ABSTRACT_LIKE = r"(?i)\b(?:abstract|index terms|related works?)\b"
RELATED_HEADING = r"(?i)\b(?:related works?|prior works?|previous works?|literature review)\b"
CITATION = r"(?i)\[[0-9]{1,3}\]|\bet al\.\b|\bdoi\b"
RESULTS_LIKE = r"(?i)\b(?:results?|evaluation|metrics?|accuracy|uf1|uar|mcc|ece)\b"
FIGURE_CUES = ["fig.", "architecture diagram"]

# Entity patterns, in order of extraction.
ENTITIES = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "url": r"(?i)\bhttps?://[^\s)\"'>]+",
    "iso_date": r"\b\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?\b",
    "us_date": r"\b(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b",
    "uuid": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b",
    "ticket": r"\b[A-Z]{2,10}-\d{1,7}\b",
    "phone": r"(?:\+\d{1,3}[\s-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}\b",
    "money": r"(?i)(?:\$|€|£|¥|₹)\s?\d[\d,]*(?:\.\d{1,2})?|\d[\d,]*(?:\.\d{1,2})?\s?(?:USD|EUR|GBP|JPY|INR)\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "version": r"\bv?\d+\.\d+(?:\.\d+)+\b",
    "policy": r"\b[A-Z]{2,}-\d{4,}-[A-Z0-9]+\b",
    "git_sha": r"(?i)\b[0-9a-f]{40}\b",
}
ID_LIKE = (
    r"(?i)\b(?:id|uid|user_id|account_id|order_id|invoice_id|customer_id|session_id|transaction_id|ref|reference|sku|arn)\b"
    r"(?:\s*[:=#]\s*|\s+)([A-Za-z0-9_-]{4,})\b"
)

# Words of the complexity score.
COMPLEX_WORDS = [
    "analyze", "compare", "contrast", "evaluate", "synthesize", "critique", "implications", "consequences", "trade-offs", "tradeoffs", "nuance", "legal",
    "regulatory", "compliance", "architecture", "design", "strategy", "recommend", "prioritize", "assess", "debate", "multi-step", "reasoning",
    "chain-of-thought", "summarize", "summarise", "summary",
]
SIMPLE_WORDS = ["what is", "define", "list", "name", "when", "where", "how many", "yes or no", "true or false", "extract", "find", "lookup"]
CONDITION_WORDS = ["if", "versus", "vs", "compared to", "difference between"]
TASK_VERBS = ["summarize", "summarise", "explain", "rewrite", "refactor", "debug", "review", "optimize", "translate", "convert"]

# Dollars for 1000 tokens in and out, in order of lookup.
PRICES = [
    ("gpt-4o", 0.0025, 0.010), ("gpt-4o-mini", 0.00015, 0.0006), ("gpt-4.1", 0.002, 0.008), ("gpt-4.1-mini", 0.0004, 0.0016), ("gpt-4.1-nano", 0.0001, 0.0004),
    ("o3", 0.002, 0.008), ("o3-mini", 0.00015, 0.0006), ("o4-mini", 0.00015, 0.0006), ("claude-opus-4", 0.015, 0.075), ("claude-sonnet-4", 0.003, 0.015),
    ("claude-haiku-3.5", 0.0008, 0.004), ("gemini-2.5-pro", 0.00125, 0.010), ("gemini-2.5-flash", 0.00015, 0.0006), ("gemini-2.0-flash", 0.0001, 0.0004), ("local", 0.0, 0.0),
]
DEFAULT_MODEL = "gpt-4o-mini"

# Headers of legal texts.
LEGAL_HEADER = (
    r"(?:(?:ARTICLE|Article)\s+[IVXLC0-9]+[.: -]?|(?:SECTION|Section)\s+\d+(?:\.\d+)*[.: -]?|(?:CLAUSE|Clause)\s+\d+(?:\.\d+)*[.: -]?"
    r"|\d+(?:\.\d+)+[)\.]?\s+|\d+\)\s+)"
)
PYTHON_DEFINITION = r"(?m)^\s*(?:def|class)\s+[A-Za-z_]\w*\b"
