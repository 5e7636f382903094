"""Fixed values. They decide results, so they are stated once, here."""

from html.entities import html5

# Python's notion of white space (str.split / str.strip), as a Java regular-expression class.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Token boundary of the keyword index: anything that is neither letter nor number.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"

# RFC 4122 namespace for URLs.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"

# Article defaults.
DEFAULT_AUTHOR = "Unknown"
DEFAULT_TITLE = "Unknown Title"
DEFAULT_SOURCE = "Unknown Source"
DEFAULT_CATEGORY = "General"

# Near-duplicate filter.
SHINGLE_WORDS = 3
NUM_PERM = 128
LSH_THRESHOLD = 0.95
LSH_BANDS = 3
LSH_ROWS = 42
FINGERPRINT_TTL_SECONDS = 604800

# Chunking and embedding.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
CHUNK_SEPARATORS = ("\n\n", "\n", " ", "")
EMBEDDING_DIM = 768

# Retrieval.
CANDIDATES = 15
SEARCH_LIMIT = 10
STREAM_CANDIDATES = 8
RERANKED = 5
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75
CACHE_TTL_SECONDS = 3600
CACHE_PREFIX = "query:"
MEANINGFUL_CHARS = 50

# External hits: per-source caps of the answer route and of the streaming route, in source order.
EXTERNAL_SOURCES = ("news", "web", "papers")
ANSWER_CAPS = {"news": 3, "web": 2, "papers": 2}
STREAM_CAPS = {"news": 2, "web": 2, "papers": 3}
HIT_SOURCE_NAMES = {"news": "Google News", "web": "DuckDuckGo", "papers": "arXiv Research"}
PAPER_CARD_SOURCE = "arXiv"
MERGED_HITS = 5
# Common values of the optional text limits of enrich_hits and web_context.
PAGE_BODY_CHARS = 2000
CONTEXT_BODY_CHARS = 1000
BLOCK_SEPARATOR = "\n---\n"

# Routing vocabulary (substring matches on the lower-cased query).
FORCE_PHRASES = ("elsewhere", "search the web", "google it", "look online", "find info")
RECENCY_WORDS = (
    "latest", "today", "recent", "new", "breaking",
    "apple ai", "2026", "openai", "anthropic", "claude",
)
COMPANY_TERMS = ("anthropic", "openai", "claude", "chatgpt", "llama", "mistral", "cohere")
FUZZY_THRESHOLD = 0.6
REASON_FORCED = "explicit request"
REASON_RECENCY = "recency keywords"
REASON_INSUFFICIENT = "insufficient local data"
REASON_FUZZY = "possible typo/fuzzy match"

# Greetings that are smalltalk on their own; longer product greetings fall under the two-word rule.
GREETINGS = ("hi", "hello", "hey", "good morning", "good evening", "good afternoon")

# Fixed replies.
NOTHING_FOUND_CONTEXT = (
    "I don't have information about this topic in my database, "
    "and I wasn't able to find current information online."
)
NO_LOCAL_CONTEXT = "I don't have information about this topic in my database."
NO_CONTEXT_ANSWER = (
    "I apologize, but I don't have enough information to answer your question about this topic. "
    "You might want to try rephrasing your question or asking about a different aspect of the topic."
)

# Named character references of HTML 5 that end with a semicolon, from the standard library's table.
NAMED_REFERENCES = {f"&{name}": chars for name, chars in html5.items() if name.endswith(";")}
