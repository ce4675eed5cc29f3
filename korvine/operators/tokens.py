"""C tokens by one alternation regex, their kinds, and normalized symbols, as array expressions of one row."""

from __future__ import annotations

from ..functions.dialect import Dialect

# The ordered alternatives and their kinds. Strings and chars are unrolled, so that no engine recurses.
PATTERNS = [
    ("comment", r"//[^\n]*"),
    ("comment", r"/\*[\s\S]*?\*/"),
    ("preproc", r"#\s*\w+[^\n]*"),
    ("literal_str", r'"[^"\\]*(?:\\.[^"\\]*)*"'),
    ("literal_char", r"'[^'\\]*(?:\\.[^'\\]*)*'"),
    ("literal_num", r"0[xX][0-9a-fA-F]+[uUlL]*"),
    ("literal_num", r"0[bB][01]+[uUlL]*"),
    ("literal_num", r"\d+\.?\d*(?:[eE][+-]?\d+)?[fFlLuU]*"),
    ("literal_num", r"\.\d+(?:[eE][+-]?\d+)?[fFlL]*"),
    ("operator", r"\.\.\."),
    ("operator", r"::"),
    ("operator", r"->"),
    ("operator", r"\+\+|--"),
    ("operator", r"<<=|>>="),
    ("operator", r"<<|>>"),
    ("operator", r"<=|>=|==|!="),
    ("operator", r"&&|\|\|"),
    ("operator", r"[+\-*/%&|^~!=<>]="),
    ("operator", r"[+\-*/%&|^~!=<>?:]"),
    ("identifier", r"[a-zA-Z_][a-zA-Z0-9_]*"),
    ("punct", r"[{}()\[\];,.]"),
]
TOKEN = "|".join(p for _, p in PATTERNS)
#: In serving, comments are stripped before, and `#` is an operator.
SERVING = "|".join(p if p != r"[+\-*/%&|^~!=<>?:]" else r"[+\-*/%&|^~!=<>?:#]" for k, p in PATTERNS if k not in ("comment", "preproc"))
# Words of the tokenizer.
KEYWORDS = [
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto", "if",
    "int", "long", "register", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef", "union", "unsigned", "void", "volatile", "while",
    "inline", "restrict", "_Bool", "_Complex", "_Imaginary", "class", "public", "private", "protected", "virtual", "override",
    "template", "typename", "namespace", "using", "new", "delete", "try", "catch", "throw", "nullptr", "bool", "true", "false",
    "const_cast", "static_cast", "dynamic_cast", "reinterpret_cast", "final", "noexcept", "explicit", "friend", "mutable", "operator",
    "this", "constexpr", "decltype", "alignas", "alignof", "static_assert",
]
TYPES = [
    "int", "char", "float", "double", "void", "long", "short", "unsigned", "signed", "bool", "size_t", "ssize_t", "ptrdiff_t",
    "uint8_t", "uint16_t", "uint32_t", "uint64_t", "int8_t", "int16_t", "int32_t", "int64_t", "intptr_t", "uintptr_t", "wchar_t", "char16_t", "char32_t",
    "FILE", "NULL", "nullptr_t",
]
# Words of the serving normalizer.
SERVING_KEYWORDS = [
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto", "if",
    "int", "long", "register", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef", "union", "unsigned", "void", "volatile", "while",
    "NULL", "true", "false", "nullptr",
]
SERVING_STDLIB = [
    "printf", "scanf", "malloc", "calloc", "realloc", "free", "memcpy", "memset", "memmove", "memcmp", "strlen", "strcpy",
    "strncpy", "strcat", "strncat", "strcmp", "strncmp", "strchr", "strrchr", "strstr", "sprintf", "snprintf", "sscanf", "fprintf",
    "fscanf", "fopen", "fclose", "fread", "fwrite", "fgets", "fputs", "exit", "abort", "atoi", "atol", "atof", "strtol", "getchar", "putchar",
    "gets", "puts", "getenv", "system", "assert", "perror", "open", "close", "read", "write", "alloca", "vprintf", "vsnprintf", "vsprintf",
]
# Words of the typed normalizer.
TYPED_KEYWORDS = [
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto", "if",
    "inline", "int", "long", "register", "restrict", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef", "union",
    "unsigned", "void", "volatile", "while", "_Bool", "_Complex", "_Imaginary", "NULL", "true", "false", "nullptr",
]
TYPED_TYPES = [
    "int", "char", "float", "double", "void", "long", "short", "signed", "unsigned", "bool", "_Bool", "size_t", "ssize_t",
    "int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "intptr_t", "uintptr_t", "ptrdiff_t", "wchar_t",
    "FILE", "time_t", "off_t", "pid_t", "uid_t", "gid_t",
]
TYPED_STDLIB = [
    "printf", "scanf", "malloc", "calloc", "realloc", "free", "memcpy", "memset", "memmove", "memcmp", "strlen", "strcpy",
    "strncpy", "strcat", "strncat", "strcmp", "strncmp", "strchr", "strrchr", "strstr", "sprintf", "snprintf", "sscanf", "fprintf",
    "fscanf", "fopen", "fclose", "fread", "fwrite", "fgets", "fputs", "fseek", "ftell", "rewind", "feof", "ferror", "fflush",
    "exit", "abort", "atexit", "atoi", "atol", "atof", "strtol", "strtoul", "strtod", "rand", "srand", "abs", "labs", "qsort",
    "bsearch", "getchar", "putchar", "gets", "puts", "getenv", "system", "assert", "perror", "errno",
]
SPECIALS = ["<PAD>", "<UNK>", "<BOS>", "<EOS>"]
#: Kinds of the tokenizer as the older interface names them.
LEGACY = {"keyword": "KEYWORD", "identifier": "IDENTIFIER", "type": "KEYWORD", "operator": "OPERATOR", "literal_num": "NUMBER", "literal_str": "STRING", "literal_char": "CHAR", "punct": "PUNCTUATION", "preproc": "KEYWORD", "comment": "COMMENT", "unknown": "IDENTIFIER"}


def kind(d: Dialect, t: str) -> str:
    """The kind of a token, from its text: which alternative took it, and its word lists."""
    return (
        f"CASE WHEN {d.has(t, '^(//|/[*])')} THEN 'comment' WHEN {d.has(t, '^#')} THEN 'preproc' WHEN {d.has(t, chr(94) + chr(34))} THEN 'literal_str' WHEN {d.has(t, chr(94) + chr(39))} THEN 'literal_char' "
        f"WHEN {d.has(t, '^[.]?[0-9]')} THEN 'literal_num' WHEN {d.among(t, TYPES)} THEN 'type' WHEN {d.among(t, ['sizeof', 'alignof'])} THEN 'keyword' WHEN {d.among(t, KEYWORDS)} THEN 'keyword' WHEN {d.has(t, '^[a-zA-Z_]')} THEN 'identifier' "
        f"WHEN {d.has(t, r'^[{}()\[\];,.]$')} THEN 'punct' ELSE 'operator' END"
    )


def serving(t: str, d: Dialect) -> str:
    """A token as serving has it: literals by their class."""
    return f"CASE WHEN {d.has(t, chr(94) + chr(34))} THEN 'STR' WHEN {d.has(t, chr(94) + chr(39))} THEN 'CHAR' WHEN {d.has(t, '^[.]?[0-9]')} THEN 'NUM' ELSE {t} END"
