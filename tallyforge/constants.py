"""Names, orders, texts, rates and patterns that results depend on."""

# Task names, in alphabetical order.
TASKS = ["Addition", "Division", "Exponentiation", "Interval", "Mean", "MinMax", "Multiplication", "Sorting", "Std"]

# Task order of the leaderboard tables.
TASK_ORDER = ["Addition", "Multiplication", "Division", "Mean", "Std", "MinMax", "Interval", "Sorting", "Exponentiation"]

# Tasks scored on a continuous scale.
REGRESSION_TASKS = ["Addition", "Division", "Exponentiation", "Mean", "Multiplication", "Std"]

# Reasoning levels in display order; unknown levels come last.
REASONING_ORDER = ["maximal", "low", "minimal", "none"]

# Tasks the generator knows.
GENERATED_TASKS = ["Addition", "Multiplication", "DivM", "Division", "Exponentiation", "Mean", "Std", "MinMax", "Sorting", "Interval"]
LIST_TASKS = ["Mean", "Std", "MinMax", "Sorting", "Interval"]

# Distributions of the number of significant digits.
DIGIT_DISTRIBUTIONS = [
    "full", "binary_uniform", "binary_triangular", "binary_exponential",
    "decimal_uniform", "decimal_triangular", "decimal_exponential",
]

# Special tokens, and the id order they get in a vocabulary.
SPECIAL_TOKENS = [
    "<|bos|>", "<|eos|>", "<|pad|>", "<|eoq|>", "<|min|>", "<|max|>", "<|asc|>", "<|desc|>",
    "<|intva|>", "<|repeat|>", "<|mean|>", "<|std|>", "<|char|>",
]
BOS, EOS, PAD, EOQ = "<|bos|>", "<|eos|>", "<|pad|>", "<|eoq|>"
NUM, OVERFLOW = "<|num|>", "<|overflow|>"
DOCUMENT_SEPARATOR = "<|eos|>\n"

# Patterns of a number in running text (signed, unsigned) and in a model answer
# (sign and exponent allowed). Written without lookahead so that every regex engine agrees.
NUMBER = r"-?(?:(?:0|[1-9][0-9]*)?[.][0-9]+|0|[1-9][0-9]*)"
UNSIGNED_NUMBER = r"(?:(?:0|[1-9][0-9]*)?[.][0-9]+|0|[1-9][0-9]*)"
ANSWER_NUMBER = r"[+-]?(?:(?:0|[1-9][0-9]*)?[.][0-9]+|0|[1-9][0-9]*)(?:[eE][+-]?[0-9]+)?"

# A token count that means the output limit was hit, and the text put in its place.
TOKEN_LIMIT = 65535
TOKEN_LIMIT_TEXT = "Token limit reached"
EXPECTED_PER_GROUP = 1000

# Labels of the answer intervals.
INTERVAL_LABELS = ["A", "B", "C", "D", "E", "F"]

# Substring rules (first hit wins), the key they give and its display name.
MODEL_RULES = [
    (["deepseek"], "deepseek-chat", "DeepSeek v3.1"),
    (["gemini-2.5-flash"], "gemini 2.5 flash", "Gemini 2.5 Flash"),
    (["gemini-2.5-pro"], "gemini 2.5 pro", "Gemini 2.5 Pro"),
    (["llama-4"], "llama 4", "Llama 4 Maverick"),
    (["kimi"], "kimi k2", "Kimi K2 0905"),
    (["gpt-4.1"], "gpt 4.1", "GPT 4.1"),
    (["gpt-5"], "gpt 5", "GPT 5"),
    (["gpt-oss", "gpt-0ss", "oss-120b", "gpt oss"], "gpt oss", "GPT OSS 120B"),
    (["qwen3", "qwen-3", "qwen/"], "qwen3", "Qwen3 235B 2507"),
]

# Model keys in table order; other keys follow in alphabetical order.
MODEL_ORDER = ["gpt oss", "qwen3", "deepseek-chat", "kimi k2", "llama 4", "gpt 5", "gemini 2.5 pro", "gemini 2.5 flash"]

# Leaderboard exclusions and replacements.
EXCLUDED_MODEL_PART = "gpt-4.1"
EXCLUDED_PAIRS = [("openai__gpt-oss-120b", "low")]
EXCLUDED_MODELS = ["x-ai__grok-4-fast_free"]
TOKENLESS_MODEL_PART, TOKENLESS_REASONING, TOKENLESS_ABOVE = "gemini-2.5-flash", "none", 200

# Price of one token by model name part, (prompt, completion).
TOKEN_RATES = {
    "gemini-2.5-flash": (0.15 / 1_000_000, 1.25 / 1_000_000),
    "gemini-2.5-pro": (0.625 / 1_000_000, 5.0 / 1_000_000),
}

# System messages by kind of answer, whole and as sent.
SYSTEM_MESSAGES = {
    "Interval": """\
You are an expert in numeracy. For each problem, output only valid JSON in this format: 
{"answer": <interval_multiple_choice_answer>}
Do not explain, show steps, or add any extra text. Do not use code blocks to output the answer.
DO NOT CALL ANY external APIs or use ANY external tool to solve the problem. DO NOT USE a calculator tool. DO NOT USE python. DO NOT USE Wolfram Alpha.
The answer must be one of the following: A, B, C, D, E, F.""",
    "Sorting": """\
You are an expert in numeracy. For each problem, output only valid JSON in this format: 
{"answer": <sorted_list>}
Do not explain, show steps, or add any extra text. Do not use code blocks to output the answer.
DO NOT CALL ANY external APIs or use ANY external tool to solve the problem. DO NOT USE a calculator tool. DO NOT USE python. DO NOT USE Wolfram Alpha.
The answer must be a list of numbers.""",
    "MinMax": """\
You are an expert in numeracy. For each problem, output only valid JSON in this format: 
{"answer": <numeric_answer>}
Do not explain, show steps, or add any extra text. Do not use code blocks to output the answer.
DO NOT CALL ANY external APIs or use ANY external tool to solve the problem. DO NOT USE a calculator tool. DO NOT USE python. DO NOT USE Wolfram Alpha.
The answer must be a single number, exactly as it appears in the list.""",
    "": """\
You are an expert in numeracy. Return exactly one valid JSON object in this format: 
{"answer": <numeric_answer>}
Do not explain, show steps, or add any extra text. Do not use code blocks to output the answer.
DO NOT CALL ANY external APIs or use ANY external tool to solve the problem. DO NOT USE a calculator tool. DO NOT USE python. DO NOT USE Wolfram Alpha.
If the answer is not an integer, give it as a decimal (not a fraction), rounded to at most 15 significant digits.""",
}

# JSON schema of the answer field by task.
ANSWER_SCHEMAS = {
    "Interval": '{"type": "string", "enum": ["A", "B", "C", "D", "E", "F"]}',
    "Sorting": '{"type": "array", "items": {"type": "number"}}',
    "": '{"type": "number"}',
}

# Strata of a stratified subset by task.
STRATA = {
    "MinMax": ["exp", "spread", "operator", "list_len"],
    "Interval": ["exp", "spread", "list_len"],
    "Mean": ["exp", "spread", "list_len"],
    "Std": ["exp", "spread", "list_len"],
    "Sorting": ["exp", "spread", "operator", "list_len"],
    "Addition": ["num1_exp", "num2_exp"],
    "Multiplication": ["num1_exp", "num2_exp"],
    "Division": ["num1_exp", "num2_exp"],
    "DivM": ["num1_exp", "num2_exp"],
    "Exponentiation": ["num1_exp", "num2_exp"],
}


def magnitude_edges() -> list[float]:
    """Inner edges of the magnitude tokens: +-2^e for 128 evenly spaced e from -33 to 34.

    The largest negative edge is left out; 255 edges in all.
    """
    step = 67.0 / 127.0
    positive = [2.0 ** (-33.0 + step * i) for i in range(127)] + [2.0 ** 34]
    return [-e for e in reversed(positive[:-1])] + positive
