"""Names, texts and numbers that results must agree on."""

TOPIC = "document.ingestion.events"

STATUSES = ("PENDING", "PROCESSING", "COMPLETE", "FAILED")
# Allowed status edges; None is the state before the first event.
STATUS_EDGES = (
    (None, "PENDING"),
    ("PENDING", "PROCESSING"),
    ("PENDING", "FAILED"),
    ("PROCESSING", "COMPLETE"),
    ("PROCESSING", "FAILED"),
    # A document that is delivered again starts anew.
    ("COMPLETE", "PENDING"),
    ("FAILED", "PENDING"),
)

SYSTEM_USER = "00000000-0000-0000-0000-000000000000"

# Column defaults by table, applied where a column or value is missing.
DEFAULTS = {
    "roles": {"permissions": "{}"},
    "user_profiles": {"preferences": "{}", "usage_tier": "standard"},
    "user_analytics": {"total_interactions": 0, "top_topics": "[]"},
    "documents": {"status": "PENDING", "user_id": SYSTEM_USER},
}

# Longest text by table and column.
LENGTHS = {
    "roles": {"role_name": 50},
    "users": {"email": 255, "password_hash": 255},
    "user_profiles": {"usage_tier": 50},
    "documents": {"file_name": 555, "status": 50},
}

ROLE_ROWS = (
    (
        1,
        "admin",
        '{"can_access_admin_tools": true, "can_query_analytics": true,'
        ' "can_write_knowledge": true, "can_chat_live": true}',
    ),
    (
        2,
        "premium",
        '{"can_access_admin_tools": false, "can_query_analytics": true,'
        ' "can_write_knowledge": true, "can_chat_live": true}',
    ),
    (
        3,
        "standard",
        '{"can_access_admin_tools": false, "can_query_analytics": false,'
        ' "can_write_knowledge": false, "can_chat_live": true}',
    ),
)

TIER_LIMITS = {"standard": 10, "premium": 50}  # requests per minute
CACHE_TTL_S = 3600
TOP_K = 5
CHUNK_TOKENS = 512
FRAME = 480

# Words that tell the topic of a message; others may be given as a table.
TOPIC_WORDS = (
    ("agent", "ai_architecture"),
    ("embedding", "ai_architecture"),
    ("model", "ai_architecture"),
    ("prompt", "ai_architecture"),
    ("token", "ai_architecture"),
    ("vector", "ai_architecture"),
    ("hello", "general"),
    ("help", "general"),
    ("question", "general"),
    ("thanks", "general"),
)

LITERAL_TOPICS = '["general", "ai_architecture"]'

# How a tool's answer is scheduled, and the arguments each tool needs.
TOOL_PRIORITY = {"rag_knowledge_search": "INTERRUPT", "query_user_analytics": "WHEN_IDLE"}
DEFAULT_PRIORITY = "WHEN_IDLE"
TOOL_ARGS = {"query_user_analytics": (), "rag_knowledge_search": ("query",)}

# Answers to callers.
DENIED = "Authorization Failure: User lacks required permission '{}'."
NO_USER = "Error: User context is missing."
NO_ANALYTICS = "No user analytics data found for user ID: {}."
NOTHING_FOUND = "No matching knowledge base documents found."
UNSUPPORTED = "Error: Tool '{}' is not supported."
ANALYTICS_LINES = (
    "User Analytics Insights:",
    "- Total Interactions: {}",
    "- Top Topics: {}",
    "- Last Updated: {}",
)
RESULT = "Result {} (Similarity: {}):\n{}"
