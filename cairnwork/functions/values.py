"""Fixed values that results depend on: word lists, patterns, quotas and tables, in their own order."""

# Prompts with these are left out by the first rule set.
BANNED_V1 = ("roleplay", "write a poem", "creative story", "fan fiction", "write a song", "sql query", "python program", "javascript", "c++", "debug this code")
# Prompts with these are about code.
CODE_V2 = ("python", "stdin", "stdout", "write a program", "write a function", "codeforces", "leetcode", "class solution", "compile", "javascript", "java", "c++", "cpp", "sql", "debug this code", "executable", "implement")
CODE_V3 = ("python", "stdin", "stdout", "write a program", "write a function", "codeforces", "leetcode", "class solution", "compile", "javascript", "java", "c++", "cpp", "sql", "debug this code", "executable", "implement", "pseudocode", "shell script", "bash script", "time complexity", "space complexity")
CODE_DISTILLED = ("python", "stdin", "stdout", "write a program", "write a function", "codeforces", "leetcode", "class solution", "compile", "javascript", "java", "c++", "cpp", "sql", "debug this code", "implement", "time complexity", "space complexity")

# Prompts with these are multiple choice; answers with these think aloud.
MULTIPLE_CHOICE = ("which of the following", "select one answer", "choose the correct answer", "multiple choice", "\na.", "\nb.", "\nc.", "\nd.", "(a)", "(b)", "(c)", "(d)")
THINKING_ALOUD = ("let's think step by step", "let us think step by step", "step-by-step", "chain of thought", "reasoning:", "solution:")

# Keywords of a category; the first category with one wins.
SCIENCE = ("physics", "chemistry", "biology", "cell", "genetics", "molecule", "atom", "force", "energy", "thermodynamics", "electric", "magnetic", "planet", "orbit", "star", "geology", "ecosystem", "climate")
PUZZLE = ("logic puzzle", "riddle", "liar", "truth-teller", "knight", "arrangement", "seating", "probability", "game", "strategy", "puzzle", "combinatorics", "deduce", "deduction")
MATH = ("prove", "triangle", "polynomial", "equation", "inequality", "integral", "derivative", "function", "matrix", "number theory", "geometry", "algebra", "find the maximum", "evaluate", "real numbers", "\\boxed", "fraction", "percentage", "ratio")
LOGIC = ("if all", "if some", "must be true", "cannot be true", "conclusion follows", "logical consequence", "syllogism", "deduce")
DATA_WORDS = ("table", "chart", "average", "median", "mean", "trend", "dataset", "graph")
SUM_WORDS = ("how many", "what percent", "total", "ratio", "probability", "equation", "solve for")
SCIENCE_V2 = ("physics", "chemistry", "biology", "cell", "genetics", "molecule", "atom", "force", "energy", "thermodynamics", "electric", "magnetic", "planet", "orbit", "star", "geology")
PUZZLE_V2 = ("logic puzzle", "riddle", "liar", "truth-teller", "knight", "arrangement", "seating", "probability", "game", "strategy", "puzzle", "combinatorics")
MATH_V2 = ("prove", "triangle", "polynomial", "equation", "inequality", "integral", "derivative", "function", "matrix", "number theory", "geometry", "algebra", "find the maximum", "evaluate", "real numbers", "\\boxed")
THOUGHT_CATEGORIES_V2 = (("science", SCIENCE_V2), ("puzzle", PUZZLE_V2), ("math", MATH_V2))
THOUGHT_CATEGORIES = (("science", SCIENCE), ("puzzle", PUZZLE), ("math", MATH))
PROMPT_CATEGORIES = (("science", SCIENCE), ("puzzle", PUZZLE), ("logic", LOGIC), ("data_analysis", DATA_WORDS), ("math", SUM_WORDS))

# Words that class manual prompts before the keywords do, and those that leave them out.
ANCHOR_SEEKING = ("budget", "compare models", "what two details", "what should i figure out first", "before comparing models")
ANCHOR_REASONING = ("study order", "what should i do first", "what makes the most sense", "stronger evidence")
ANCHOR_LEFT_OUT = ("phishing", "exactly two bullets")
ANCHOR_EVIDENCE = ("evidence", "compare", "which is stronger")

# Beginnings that are taken off, each once, in this order.
ANSWER_BEGINNINGS = (
    r"^let'?s think step by step[:,\s-]*", r"^let'?s solve this(?: carefully)?[:,\s-]*", r"^we need to[:,\s-]*", r"^here(?:'s| is) (?:a )?(?:concise )?solution[:,\s-]*", r"^step-by-step explanation[:,\s-]*",
    r"^solution[:,\s-]*", r"^reasoning[:,\s-]*", r"^step\s*\d+[:.)\-\s]*", r"^\d+\.\s*", r"^(?:first|second|third|finally)[,:\s-]+",
)
PROMPT_BEGINNINGS = (r"^return your final response within\s+\\boxed\{\}\.?\s*", r"^give your final answer in\s+\\boxed\{\}\.?\s*", r"^put your final answer in\s+\\boxed\{\}\.?\s*")
# Where an answer stands, in order of preference.
ANSWER_PLACES = (r"\\boxed\{([^{}]{1,120})\}", r"(?i)(?:final answer|answer)\s*[:\-]\s*([^\n.]{1,160})", r"(?i)the answer is\s+([^\n.]{1,160})")
MARKUP = ("<|begin_of_solution|>", "<|end_of_solution|>", "<|begin_of_thought|>", "<|end_of_thought|>", "**", "__")

# Limits of a valid pair and of an answer, by rule set.
PAIR_LIMITS = {
    "v1": {"user": (40, 800), "assistant": (40, 1600)},
    "v2": {"user": (40, 900), "assistant": (40, 2200)},
    "v3": {"user": (40, 700), "assistant": (50, 900), "words": 220, "newlines": 4},
    "distilled": {"user": (35, 650), "assistant": (35, 700), "words": 110, "newlines": 2},
    "distilled2": {"user": (35, 650), "assistant": (35, 850), "words": 130, "newlines": 2},
}
REWARDS = {"v1": 0.14, "v2": 0.14, "v3": 0.18, "distilled": 0.24, "distilled2": 0.17}
QUOTAS_V3 = {"math": 28, "science": 60, "puzzle": 50, "general-reasoning": 42}

# Pre-token rule and special tokens.
SPLIT_PATTERN = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
SPECIAL_TOKENS = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>")

# Accuracy by chance of the chat tasks.
CHANCE = {"ARC-Easy": 0.25, "ARC-Challenge": 0.25, "MMLU": 0.25, "GSM8K": 0.0, "HumanEval": 0.0, "SpellingBee": 0.0}

# BF16 operations a second of a device whose lowered name holds all the words; the first that fits counts.
PEAK_FLOPS = (
    (("gb200",), 2.5e15), (("grace blackwell",), 2.5e15), (("b200",), 2.25e15), (("b100",), 1.8e15),
    (("h200", "nvl"), 836e12), (("h200", "pcie"), 836e12), (("h200",), 989e12), (("h100", "nvl"), 835e12), (("h100", "pcie"), 756e12), (("h100",), 989e12), (("h800", "nvl"), 989e12), (("h800",), 756e12),
    (("a100",), 312e12), (("a800",), 312e12), (("a40",), 149.7e12), (("a30",), 165e12),
    (("l40s",), 362e12), (("l40-s",), 362e12), (("l40 s",), 362e12), (("l4",), 121e12),
    (("mi355",), 2.5e15), (("mi325",), 1.3074e15), (("mi300x",), 1.3074e15), (("mi300a",), 980.6e12), (("mi250x",), 383e12), (("mi250",), 362.1e12),
    (("5090",), 209.5e12), (("4090",), 165.2e12), (("3090",), 71e12),
)

# Ways to ask how often a letter stands in a word, and marks around either.
COUNT_QUESTIONS = (
    "How many {letter} are in the word {word}", "How many {letter} are in {word}", "Count the number of {letter} in {word}", "How many times does {letter} appear in {word}", "What's the count of {letter} in {word}",
    "In the word {word}, how many {letter} are there", "How many letter {letter} are in the word {word}", "Count how many {letter} appear in {word}", "Tell me the number of {letter} in {word}", "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}", "Can you count the {letter} letters in {word}", "What is the frequency of {letter} in {word}", "How many {letter}s are in {word}", "How many {letter}'s are in {word}",
    "Count all the {letter} in {word}", "How many times is {letter} in {word}", "Number of {letter} in {word}", "Total count of {letter} in {word}", "How many {letter} does {word} have",
    "How many {letter} does {word} contain", "What's the number of {letter} in {word}", "{word} has how many {letter}", "In {word}, count the {letter}", "How many {letter} appear in {word}",
    "Count the {letter} in {word}", "Give me the count of {letter} in {word}", "How many instances of {letter} in {word}", "Show me how many {letter} are in {word}", "Calculate the number of {letter} in {word}",
    "¿Cuántas {letter} hay en {word}?", "¿Cuántas veces aparece {letter} en {word}?", "Cuenta las {letter} en {word}", "¿Cuántas letras {letter} tiene {word}?",
    "{word}中有多少个{letter}", "{word}里有几个{letter}", "数一下{word}中的{letter}", "{word}这个词里有多少{letter}",
    "{word}에 {letter}가 몇 개 있나요", "{word}에서 {letter}의 개수는", "{word}에 {letter}가 몇 번 나오나요", "{word}라는 단어에 {letter}가 몇 개",
    "Combien de {letter} dans {word}", "Combien de fois {letter} apparaît dans {word}", "Compte les {letter} dans {word}",
    "Wie viele {letter} sind in {word}", "Wie oft kommt {letter} in {word} vor", "Zähle die {letter} in {word}",
    "{word}に{letter}は何個ありますか", "{word}の中に{letter}がいくつ", "{word}に{letter}が何回出てくる",
)
QUOTES = ("", "'", '"')
