"""Word lists, tables, patterns and constants that results depend on."""

from __future__ import annotations

# Abbreviations in titles.
TITLE_WORDS = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "eng": "engineer", "engr": "engineer", "dev": "developer", "mgr": "manager",
    "ai": "artificial intelligence", "ml": "machine learning", "swe": "software engineer", "sde": "software engineer", "fe": "frontend", "be": "backend",
    "fullstack": "full stack", "full-stack": "full stack", "ii": "2", "iii": "3", "iv": "4",
}
TITLE_DROPPED = ("remote", "hybrid", "onsite")

# Other names of places.
PLACES = {
    "us": "united states", "usa": "united states", "u.s.": "united states", "u.s.a.": "united states", "united states of america": "united states",
    "uk": "united kingdom", "u.k.": "united kingdom", "great britain": "united kingdom", "uae": "united arab emirates",
    "anywhere": "worldwide", "global": "worldwide", "remote - worldwide": "worldwide", "bengaluru": "bangalore",
}

# Work models. They're valid in Java and RE2.
REMOTE = r"\b(fully[\s-]remote|100%\s*remote|remote[\s-]first|remote|work\s+from\s+home|wfh|distributed\s+team|anywhere)\b"
HYBRID = r"\b(hybrid|\d\s*days?\s+(a|per)\s+week\s+in[\s-]office)\b"
ONSITE = r"\b(on[\s-]?site|in[\s-]office|office[\s-]based|relocat(e|ion)\s+required)\b"

# Seniority by title, first match counts, and its rank.
SENIORITY = (
    ("intern", r"\b(intern|internship|trainee)\b"),
    ("director", r"\b(director|head of|vp|vice president)\b"),
    ("principal", r"\bprincipal\b"),
    ("staff", r"\bstaff\b"),
    ("manager", r"\b(engineering manager|manager)\b"),
    ("lead", r"\b(lead|tech lead)\b"),
    ("senior", r"\b(senior|sr\.?|snr)\b"),
    ("junior", r"\b(junior|jr\.?|graduate|entry[\s-]level|associate)\b"),
    ("mid", r"\b(mid[\s-]level|intermediate|engineer ii|developer ii)\b"),
)
SENIORITY_RANK = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "lead": 4, "staff": 4, "manager": 4, "principal": 5, "director": 6}

# Tracking parameters of URLs, default ports, domains of two levels.
TRACKING = ("gclid", "fbclid", "msclkid", "ref", "referrer", "source", "src", "gh_src", "lever-source", "lever-origin", "trk", "trkid", "igshid", "yclid")
TRACKING_PREFIXES = ("utm_", "mc_", "_hs", "hsa_", "pk_")
TWO_LEVEL = ("co.uk", "co.in", "com.au", "co.jp", "com.br", "co.nz", "org.uk", "ac.uk")

# Skills and their names in postings.
SKILLS = {
    "python": ("python", "python3"), "fastapi": ("fastapi",), "django": ("django",), "flask": ("flask",), "pydantic": ("pydantic",), "sqlalchemy": ("sqlalchemy",),
    "postgresql": ("postgresql", "postgres", "psql"), "mysql": ("mysql",), "mongodb": ("mongodb", "mongo"), "redis": ("redis",), "kafka": ("kafka",),
    "temporal": ("temporal.io", "temporal workflows", "temporal"), "docker": ("docker", "containers"), "kubernetes": ("kubernetes", "k8s"), "terraform": ("terraform",),
    "aws": ("aws", "amazon web services"), "gcp": ("gcp", "google cloud"), "azure": ("azure",), "typescript": ("typescript", "ts"),
    "javascript": ("javascript", "js", "node.js", "nodejs"), "react": ("react", "react.js", "reactjs"), "next.js": ("next.js", "nextjs"), "go": ("golang", "go"),
    "rust": ("rust",), "java": ("java",), "llm": ("llm", "llms", "large language model", "large language models"),
    "rag": ("rag", "retrieval augmented generation", "retrieval-augmented generation"), "langchain": ("langchain",), "langgraph": ("langgraph",),
    "agentic ai": ("agentic ai", "ai agents", "agentic", "autonomous agents"), "openai": ("openai", "gpt-4", "gpt-5", "chatgpt"), "prompt engineering": ("prompt engineering",),
    "vector databases": ("vector database", "vector databases", "pgvector", "pinecone", "weaviate", "qdrant"), "machine learning": ("machine learning", "ml"),
    "deep learning": ("deep learning",), "pytorch": ("pytorch",), "tensorflow": ("tensorflow",), "nlp": ("nlp", "natural language processing"), "mlops": ("mlops",),
    "airflow": ("airflow",), "spark": ("spark", "pyspark"), "graphql": ("graphql",), "rest apis": ("rest api", "rest apis", "restful"), "microservices": ("microservices",),
    "ci/cd": ("ci/cd", "github actions", "continuous integration"), "observability": ("opentelemetry", "observability", "prometheus", "grafana"),
}

# Other names of regions.
REGIONS = {
    "worldwide": "worldwide", "anywhere": "worldwide", "global": "worldwide", "globally": "worldwide", "north america": "north america", "americas": "americas",
    "latam": "latam", "latin america": "latam", "europe": "europe", "eu": "europe", "european union": "europe", "eea": "europe", "dach": "europe", "nordics": "europe",
    "benelux": "europe", "emea": "emea", "apac": "apac", "asia pacific": "apac", "asia-pacific": "apac", "asia": "asia",
}

# Time zones by name and by phrase, their hours from UTC, and how near is near.
ZONES = {
    "pst": "PST", "pdt": "PST", "pt": "PST", "pacific": "PST", "est": "EST", "edt": "EST", "et": "EST", "eastern": "EST", "cst": "CST", "cdt": "CST", "central": "CST",
    "mst": "MST", "mdt": "MST", "mountain": "MST", "gmt": "GMT", "utc": "GMT", "bst": "BST", "cet": "CET", "cest": "CET", "eet": "EET", "eest": "EET", "ist": "IST",
    "sgt": "SGT", "aest": "AEST", "jst": "JST",
}
ZONE_PHRASES = {
    "us hours": "EST", "us business hours": "EST", "us time zones": "EST", "us timezones": "EST", "north american time zones": "EST", "european hours": "CET",
    "european time zones": "CET", "uk hours": "GMT",
}
ZONE_HOURS = {"PST": -8.0, "MST": -7.0, "CST": -6.0, "EST": -5.0, "GMT": 0.0, "BST": 1.0, "CET": 1.0, "EET": 2.0, "IST": 5.5, "SGT": 8.0, "JST": 9.0, "AEST": 10.0}
NEAR_HOURS = 3.5
ZONE_IN_CONTEXT = r"([^.\n]{0,60})\b(PST|PDT|PT|EST|EDT|ET|CST|CDT|MST|MDT|GMT|UTC|BST|CET|CEST|EET|EEST|IST|SGT|AEST|JST|pacific|eastern|central|mountain)\b([^.\n]{0,40})"
TIME_WORDS = r"time\s*zone|timezone|hours|overlap|working\s+hours|business\s+hours|\btime\b"
STRICT_WORDS = r"\b(must|required|requires|need\s+to|only|strictly|mandatory)\b"

# Experience, residency and how requirements are weakened.
PLACE = r"(?:the\s+)?(u\.?s\.?a?\.?|united\s+states(?:\s+of\s+america)?|america|canada|u\.?k\.?|united\s+kingdom|europe|eu|[A-Z][a-z]+)"
RESIDENCY = (
    rf"\bmust\s+(?:currently\s+)?(?:reside|live|be\s+(?:based|located))\s+in\s+{PLACE}",
    rf"\b(?:only\s+)?(?:open\s+to|accepting|considering)\s+(?:candidates|applicants)\s+(?:who\s+(?:are|reside)\s+)?(?:based\s+|located\s+|residing\s+)?in\s+{PLACE}",
    rf"\b(?:legally\s+)?authori[sz]ed\s+to\s+work\s+in\s+{PLACE}",
    rf"\b{PLACE}[\s-]+(?:only|based\s+only|residents?\s+only|citizens?\s+only)\b",
    r"\b(u\.?s\.?)\s+citizenship\s+(?:is\s+)?required\b",
    r"\b(?:active\s+)?(u\.?s\.?)\s+(?:security\s+)?clearance\b",
)
EXPERIENCE = r"(\d{1,2}(?:\.\d)?)\s*(?:\+|plus)?\s*(?:(?:-|–|—|to)\s*(\d{1,2}(?:\.\d)?)\s*\+?)?\s*(?:years?|yrs?)(?:\s+of)?(?:\s+\w+){0,6}?\s+(?:experience|exp\b)"
LEAST_EXPERIENCE = r"(?:at\s+least|minimum(?:\s+of)?|min\.?)\s+(\d{1,2})\s*(?:years?|yrs?)"
PREFERRED = r"preferred|nice[\s-]to[\s-]have|bonus points|desirable|ideally"
REQUIRED = r"required|requirements|must have|you must|minimum qualifications|basic qualifications|you(?:'ll| will) need"
PREFERRED_AFTER = r"[^.\n]{0,40}\b(?:is a plus|a plus|preferred|nice to have|is a bonus)\b"
LOOK_BEHIND, LOOK_AHEAD, MOST_YEARS = 400, 60, 20

# Scoring.
WEIGHTS = {"skill_match": 0.30, "semantic_similarity": 0.20, "role_similarity": 0.15, "seniority_fit": 0.15, "location_timezone_fit": 0.10, "freshness": 0.10}
HALF_LIFE_DAYS, PREFERRED_SKILL, UNKNOWN_CREDIT, UNKNOWN_FRESHNESS, SURE = 7.0, 0.5, 0.6, 0.5, 0.6

# Polling.
POLL_LADDER = (60, 120, 300, 600, 900, 1800, 3600)
POLL_FAILURES, POLL_CIRCUIT_SECONDS, POLL_MOST_SECONDS = 5, 6 * 3600, 4 * 3600
