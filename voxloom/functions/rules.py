"""Word lists, patterns and limits the results depend on."""

# --- fixed values: sentence and segment boundaries
TERMINAL = (".", "?", "!", ";", ":", "。", "？", "！")
SEGMENT_ENDINGS = (".", "?", "!")
SENTENCE_LEFT = (
    "a", "an", "the", "and", "or", "but", "of", "to", "for", "with", "by",
    "as", "that", "which", "who", "whose", "what", "when", "where", "how",
    "will", "would", "could", "should", "can", "may", "might", "must",
    "is", "are", "was", "were", "be", "been", "being",
)
SENTENCE_RIGHT = ("of", "to", "for", "with", "by", "as", "than", "from")

# --- fixed values: cue boundaries
FORMULA_TOKENS = (
    "d", "r", "x", "y", "t", "u", "v", "n", "pi", "π", "dr", "dx", "dy", "dt", "over",
    "squared", "cubed", "/", "*", "×", "+", "-", "=", "^2", "^3",
)
FORMULA_MARKERS = (
    "d", "pi", "π", "dr", "dx", "dy", "dt", "over", "squared", "cubed",
    "/", "*", "×", "+", "-", "=", "^2", "^3",
)
NUMBER_TOKEN = r"^\d+(?:[./]\d+)?$"
CUE_LEFT = (
    "a", "an", "the", "and", "or", "but", "of", "to", "for", "with", "by",
    "as", "that", "which", "who", "whose", "what", "when", "where", "how",
    "include", "includes", "including", "known", "called", "named", "type", "kind",
    "will", "would", "could", "should", "can", "may", "might", "must",
    "is", "are", "was", "were", "be", "been", "being",
    "all", "each", "every", "some", "any", "no", "not", "their", "our", "your", "likely",
)
CUE_RIGHT = (
    "of", "to", "for", "with", "by", "as", "than", "from",
    "also", "another", "based", "change", "data", "values", "what",
)
CUE_PAIRS = (("known", "as"), ("type", "of"), ("kind", "of"), ("one", "another"))

# --- fixed values: notation
NO_LETTER_BEFORE = "(?<![A-Za-zÀ-ỹ])"
NO_LETTER_AFTER = "(?![A-Za-zÀ-ỹ])"
DIFFERENTIALS = ("dr", "dx", "dy", "dt")
CONTEXT_TERMS = (
    "integral", "derivative", "differential", "radius", "radii", "ring", "thickness", "area",
    "2 pi", "pi r", "π", "with respect to",
)
CONFUSABLE = f"{NO_LETTER_BEFORE}doctor{NO_LETTER_AFTER}"
SPOKEN = (
    ("dy/dx", "d y trên d x"),
    ("d/dx", "d trên d x"),
    ("d/dt", "d trên d t"),
    ("πr²", "pi r bình phương"),
    ("π r²", "pi r bình phương"),
    ("½", "một phần hai"),
    ("×", " nhân "),
)
# (rule, pattern, canonical, spoken, display, kind); {1} and {2} stand for captured letters
SPAN_RULES = (
    ("calculus.dy_dx", r"(?i)dy\s*/\s*dx", "dy/dx", "d y trên d x", "dy/dx", "calculus_notation"),
    ("calculus.d_dx", r"(?i)d\s*/\s*dx", "d/dx", "d trên d x", "d/dx", "calculus_notation"),
    ("calculus.d_dt", r"(?i)d\s*/\s*dt", "d/dt", "d trên d t", "d/dt", "calculus_notation"),
    ("calculus.dx_squared_words", r"(?i)(?U)\bdx\s+squared\b", "dx²", "d x bình phương", "dx²", "calculus_notation"),
    ("calculus.pi_r_squared", r"(?iu)π\s*r\s*(?:²|\^2)", "πr²", "pi r bình phương", "πr²", "formula"),
    ("calculus.pi_r_squared_words", r"(?i)(?U)\bpi\s+r\s+squared\b", "πr²", "pi r bình phương", "πr²", "formula"),
    ("calculus.one_half", r"(?i)(?U)½|\b1\s*/\s*2\b|\bone\s+half\b", "½", "một phần hai", "½", "fraction"),
    ("calculus.dr", rf"(?i){NO_LETTER_BEFORE}dr{NO_LETTER_AFTER}", "dr", "d r", "dr", "calculus_notation"),
    ("calculus.dx", rf"(?i){NO_LETTER_BEFORE}dx{NO_LETTER_AFTER}", "dx", "d x", "dx", "calculus_notation"),
    ("calculus.dy", rf"(?i){NO_LETTER_BEFORE}dy{NO_LETTER_AFTER}", "dy", "d y", "dy", "calculus_notation"),
    ("calculus.dt", rf"(?i){NO_LETTER_BEFORE}dt{NO_LETTER_AFTER}", "dt", "d t", "dt", "calculus_notation"),
    ("calculus.function_squared_words", rf"(?i)(?U){NO_LETTER_BEFORE}([A-Za-z])\s+of\s+([A-Za-z])\s+squared\b",
     "{1}({2})²", "{1}({2}) bình phương", "{1}({2})²", "power"),
    ("calculus.variable_squared", rf"{NO_LETTER_BEFORE}([A-Za-z])(?:²|\^2){NO_LETTER_AFTER}",
     "{1}²", "{1} bình phương", "{1}²", "power"),
    ("calculus.variable_squared_words", rf"(?i)(?U){NO_LETTER_BEFORE}([A-Za-z])\s+squared\b",
     "{1}²", "{1} bình phương", "{1}²", "power"),
)
FORBIDDEN = {"dr": ("doctor", "bác sĩ", "tiến sĩ")}
GLOSSARY_SEEDS = (
    ("dr", "d r", "calculus_notation", "d r", "dr"),
    ("dx", "d x", "calculus_notation", "d x", "dx"),
    ("dy", "d y", "calculus_notation", "d y", "dy"),
    ("dt", "d t", "calculus_notation", "d t", "dt"),
    ("dx squared", "d x bình phương", "calculus_notation", "d x bình phương", "dx²"),
    ("dy/dx", "d y trên d x", "calculus_notation", "d y trên d x", "dy/dx"),
    ("d/dx", "d trên d x", "calculus_notation", "d trên d x", "d/dx"),
    ("πr²", "pi r bình phương", "formula", "pi r bình phương", "πr²"),
    ("½", "một phần hai", "fraction", "một phần hai", "½"),
)

# --- fixed values: comparison of heard and expected speech
DIGIT_WORDS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")
TOKEN_ALIASES = {
    "doctor": ["dr"], "ích": ["x"], "dx": ["d", "x"], "dt": ["d", "t"], "dm": ["d", "m"],
    "dy": ["d", "y"], "di": ["d", "y"], "pt": ["d", "t"], "bx": ["d", "x"], "decimet": ["d", "m"],
    "mét": ["m"], "met": ["m"], "dây": ["giây"], "triều": ["chiều"], "đảo": ["đạo"],
}
FACTOR_TOKEN = r"^(?:pi|r|dr|dx|dy|dt|dm|pr|drx|trx|\d+|\d+p|\d+pr)$"

# --- fixed values: translation and review
FILLERS = (
    "Bây giờ ", "bây giờ ", "chúng ta hãy cùng nhau ", "hãy cùng nhau ",
    "thật chi tiết ", "trong ví dụ này", "một cách ", "rất ",
)
HIGH_RISK = (
    "chunk_text_fallback", "cue_duration_exceeds_max_for_safe_boundary", "hard_split", "no_speech_detected",
    "segment_over_hard_max", "timestamps_missing", "source_normalized_repetitive_asr_loop",
    "tts_timing_density_high", "word_timestamps_missing",
)
MANUAL_CODES = (
    "tts_duration_exceeds_max_speedup", "tts_semantic_quality_failed",
    "tts_rephrase_empty", "tts_rephrase_exceeds_char_limit",
)
# non-Latin scripts reported for suspicious text
SCRIPTS = (
    ("Arabic", r"\p{IsArabic}"), ("Armenian", r"\p{IsArmenian}"), ("Bengali", r"\p{IsBengali}"),
    ("Cjk", r"\p{IsHan}"), ("Cyrillic", r"\p{IsCyrillic}"), ("Devanagari", r"\p{IsDevanagari}"),
    ("Georgian", r"\p{IsGeorgian}"), ("Greek", r"\p{IsGreek}"), ("Hangul", r"\p{IsHangul}"),
    ("Hebrew", r"\p{IsHebrew}"), ("Hiragana", r"\p{IsHiragana}"), ("Katakana", r"\p{IsKatakana}"),
    ("Tamil", r"\p{IsTamil}"), ("Thai", r"\p{IsThai}"), ("Replacement", "�"),
)

# --- fixed values: stages in order, and the artifacts each must leave behind
STAGES = ("job_init", "audio_extract", "vad", "asr", "glossary", "translation", "tts", "mixing")
REQUIRED_ARTIFACTS = (
    ("job_init", "input_metadata", 1), ("audio_extract", "audio_analysis", 1), ("vad", "segments", 1),
    ("asr", "asr_segments", 1), ("asr", "transcript", 1), ("asr", "source_normalization", 1),
    ("glossary", "glossary", 1), ("translation", "translation_blocks", 1), ("translation", "dubbing_cues", 2),
    ("translation", "speech_timeline", 1), ("translation", "translated", 2), ("tts", "tts_segments", 1),
    ("tts", "tts_manifest", 1), ("tts", "spoken_cues", 1), ("mixing", "output_video", 1),
)
CHECKPOINT_ARTIFACTS = {
    "asr": "asr_segments", "glossary": "glossary_blocks", "translation": "translation_blocks", "tts": "tts_segments",
}
