"""Values that results depend on, and the schema of a chunk."""

from __future__ import annotations

from pyspark.sql import types as T

# Weights, limits and sizes that results follow from.
DENSE_WEIGHT, LEXICAL_WEIGHT, RRF_K = 1.0, 0.2, 60
RERANK_ALPHA, RERANK_TOP = 0.5, 20
MIN_COVERAGE, MIN_SIMILARITY, IDF_FLOOR = 0.65, 0.10, 0.01
BM25_K1, BM25_B = 1.2, 0.75
VECTOR_CANDIDATES, KEYWORD_CANDIDATES = 50, 50
GRAPH_NEIGHBOURS, GRAPH_MIN_WEIGHT = 6, 0.15
CONTEXT_CHARS, CONTEXT_CANDIDATES = 10_000, 3
CHUNK_TOKENS, CHUNK_OVERLAP, PREFIX_TOKENS, SPECIAL_TOKENS = 256, 40, 32, 2
UNIT_TOLERANCE = 1e-3
MAX_TOP_K = 30
THRESHOLD_TOLERANCE = 0.02

# Fixed values.
KINDS = ("decision", "summary", "note", "prompt", "doc")
RESERVED_SCOPES = ("all", "*", "current", "")
OPEN_NAMESPACES = ("shared", "Promtlarim")
GENERIC_SOURCES = ("save_memory", "upload", "web_search", "web_page")
APOSTROPHES = "'`’ʻʼ"
STRIP_SUFFIXES = ("ning", "lar", "dan", "tan", "ni", "ga", "ka", "qa", "da", "ta")
STEM_SUFFIXES = (
    "larning larni lari lar ning niki dagi dan dek cha ni ga da imiz ingiz si amiz aymiz adimi ydimi adi aydi ganmiz ganmi gan dimi moqda moq yapti "
    "yotgan masligi ligi lik ish ib di li yot"
).split()
STOP_WORDS = (
    "nima nimaga qanday qanaqa qaysi qayerda qachon kim nega qiladi qilish ishlatiladi ishlatish haqida ber bering ayt aytib tushuntir ko'rsat va bilan "
    "uchun bu shu ma'lumot ma'lumotlar what how why which where when who does do is are used use using about tell me explain show the a an and for of to "
    "in it can you i"
).split()

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType(), False), T.StructField("document", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("kind", T.StringType()), T.StructField("tags", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("project", T.StringType()), T.StructField("date", T.StringType()), T.StructField("author", T.StringType()),
        T.StructField("est_tokens", T.IntegerType()), T.StructField("parent_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_total", T.IntegerType()), T.StructField("token_count", T.IntegerType()), T.StructField("shortcode", T.StringType()),
        T.StructField("canonical_id", T.StringType()), T.StructField("usable", T.StringType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
