"""Small inputs that the named queries and their SQL share."""

QUESTIONS = [(1, "thatin ononst thing"), (2, "inoran hehely thing thing"), (3, "attion ering results"), (4, "how the procedure of attion works")]
SYNONYM_GROUPS = [(1, "thing"), (1, "attion"), (1, "hehely"), (2, "ering"), (2, "oning"), (2, "thing"), (3, "inoran"), (3, "ononst"), (3, "thatin")]
MODEL_NAMES = ["gpt-4o", "GPT-4o-mini-2024", "o3", "gpt-4.1-mini-x", "unknown", " claude-opus-4 ", ""]
