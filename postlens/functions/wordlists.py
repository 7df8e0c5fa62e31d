"""Word lists, vocabularies and templates.

FIXED VALUES: the lists below must equal the observed behaviour word for word
(stoplists, noise words, title rules, taxonomy, keyword dictionary, synonym
pairs, default texts).  They are kept here, in their natural order, and every
operator takes them as parameters with these as defaults.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — vocabularies and labels
# ---------------------------------------------------------------------------
SENTIMENTS = ["positive", "neutral", "negative"]
ASPECTS = ["pricing", "delivery", "returns", "staff", "app/ux"]
ASPECT_KEYS = ["pricing", "delivery", "returns", "staff", "app_ux"]
ASPECT_FALLBACK = "Other"
ASPECT_STORED_FALLBACK = "none"
ASPECT_THRESHOLD = 0.5

# ---------------------------------------------------------------------------
# FIXED VALUES — column-role precedence lists
# ---------------------------------------------------------------------------
TEXT_INGEST = ["text_clean", "text", "fulltext", "tweet", "tweet_text", "message"]
TEXT_THEMES = ["text_used", "clean_tweet", "text", "fulltext"]
TEXT_BRIEF = ["clean_tweet", "text_used", "text", "fulltext"]
TEXT_BRIEF_PREP = ["text", "text_used", "clean_tweet", "text_clean", "fulltext", "tweet_text", "content"]
TEXT_SAMPLE = ["text", "clean_tweet", "text_used", "fulltext", "tweet_text", "text_clean"]
DATE_API = ["createdat", "created_dt", "created_at", "tweet_date", "date", "dt", "timestamp"]
DATE_THEMES = ["createdat", "created_dt", "created_at", "tweet_date", "date", "dt"]
DATE_BRIEF = ["created_at", "date", "timestamp"]
DATE_INGEST = [
    "created_at", "createdAt", "created_time", "creation_time",
    "timestamp", "time", "post_time", "posted_at",
    "tweet_created_at", "tweet_time",
    "date", "datetime", "Date", "DateTime", "DATE",
    "created_utc", "epoch", "unix", "unix_time",
]
ID_DEDUPE = ["tweet_id", "id_str", "id", "status_id"]

# ---------------------------------------------------------------------------
# FIXED VALUES — stoplist used by theme keywords, noise test and similarity
# ---------------------------------------------------------------------------
THEME_STOPWORDS = [
    "walmart", "rt", "amp", "https", "http", "co", "www", "com", "org", "net",
    "user", "users", "you", "your", "yours", "u", "ur", "me", "we", "us", "they", "them",
    "im", "ive", "dont", "didnt", "cant", "couldnt", "wont", "wouldnt", "shouldnt",
    "like", "just", "get", "got", "one", "two", "three", "also", "still", "even",
    "going", "go", "gotta", "gonna", "really", "please", "thanks", "thank", "help",
    "hey", "hi", "hello", "ok", "okay", "any", "every", "everyone", "someone", "anyone",
    "today", "yesterday", "tomorrow", "now", "time", "back", "make", "made", "see",
    "store", "stores", "shop", "shopping", "customer", "customers", "people",
    "good", "bad", "great", "best", "worst", "better", "worse",
    "buy", "bought", "purchase", "purchased", "sale", "sales",
    "app", "apps", "site", "website", "httpst", "httpsco", "tco",
    "fuck", "fucking", "fucked", "shit", "damn", "hell", "ass", "bitch",
    "wutangkids", "grok", "don", "flipkart", "flipkartsupport", "walmartinc",
    "sarahhuckabee", "payoneer", "_kalyan_k", "h1b", "radioactive",
    "sentomcotton", "spencerhakimian", "solporttom", "mrpunkdoteth", "matt_vanswol",
    "awsten", "flagusanetwork", "cz_binance", "twentyonepilots",
    "topics", "things", "stuff", "way", "ways", "thing", "something", "anything",
    "new", "day", "global", "debt", "fbi", "their", "there", "they", "them", "these",
    "images", "divine", "waterparks", "waterpark", "target", "amazon",
    "about", "never", "always", "every", "all", "some", "many", "much", "more", "most",
    "very", "really", "quite", "just", "only", "also", "still", "even", "yet", "already",
    "nctsmtown", "nct", "smtown",
    "motif", "motifs",
    "would", "could", "should", "will", "can", "may", "might", "must", "shall",
    "because", "since", "while", "when", "where", "what", "which", "who", "whom",
    "company", "business", "themes", "theme", "school", "awesome", "doing", "right",
    "bullish", "judgment", "spiritual", "available", "students",
]

# FIXED VALUES — the shorter stoplist of the period-summary keywords
SUMMARY_STOPWORDS = [
    "walmart", "rt", "amp", "https", "http", "co", "www", "com", "org", "net",
    "user", "users", "you", "your", "yours", "u", "ur", "me", "we", "us", "they", "them",
    "im", "ive", "dont", "didnt", "cant", "couldnt", "wont", "wouldnt", "shouldnt",
    "like", "just", "get", "got", "one", "two", "three", "also", "still", "even",
    "going", "go", "gotta", "gonna", "really", "please", "thanks", "thank", "help",
    "hey", "hi", "hello", "ok", "okay", "any", "every", "everyone", "someone", "anyone",
    "today", "yesterday", "tomorrow", "now", "time", "back", "make", "made", "see",
    "store", "stores", "shop", "shopping", "customer", "customers", "people",
    "good", "bad", "great", "best", "worst", "better", "worse",
    "buy", "bought", "purchase", "purchased", "sale", "sales",
    "app", "apps", "site", "website", "httpst", "httpsco", "tco",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — noise-word test (C4)
# ---------------------------------------------------------------------------
PROFANITY = ["fuck", "fucking", "fucked", "shit", "damn", "hell", "ass", "bitch"]
KNOWN_HANDLES = [
    "sentomcotton", "spencerhakimian", "solporttom", "mrpunkdoteth",
    "matt_vanswol", "awsten", "flagusanetwork", "cz_binance",
    "twentyonepilots", "wutangkids", "grok", "flipkart",
]
GENERIC_WORDS = [
    "their", "there", "they", "them", "these", "this", "that", "those",
    "about", "never", "always", "every", "all", "some", "many", "much",
    "more", "most", "very", "really", "quite", "just", "only", "also",
    "still", "even", "yet", "already", "nctsmtown", "nct", "smtown",
    "would", "could", "should", "will", "can", "may", "might", "must",
    "because", "since", "while", "when", "where", "what", "which", "who",
    "company", "business", "themes", "theme", "school", "awesome",
    "doing", "right", "bullish", "judgment", "spiritual", "available", "students",
    "motif", "motifs",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — business terms boosted by the weighted keywords
# ---------------------------------------------------------------------------
BUSINESS_TERMS = [
    "service", "support", "help", "assistance", "staff", "employee", "worker",
    "price", "pricing", "cost", "tariff", "fee", "charge", "expensive", "cheap",
    "delivery", "shipping", "fulfillment", "order", "purchase", "buy",
    "product", "item", "quality", "defect", "broken", "damaged",
    "return", "refund", "exchange", "warranty",
    "store", "location", "visit", "shopping", "experience",
    "app", "website", "online", "digital", "mobile",
    "customer", "client", "satisfaction", "complaint", "issue", "problem",
    "availability", "stock", "inventory", "out", "sold",
    "brand", "corporate", "company", "business",
]
DEFAULT_KEYWORDS = ["customer", "service", "product", "quality", "price", "delivery", "experience", "support"]
# first words dropped from per-theme TF-IDF keywords besides the stoplist
KEYWORD_EXTRA_DROP = ["wutangkids", "grok", "don", "flipkart", "payoneer", "sarahhuckabee", "walmartinc"]

# ---------------------------------------------------------------------------
# FIXED VALUES — meaningless-title rules
# ---------------------------------------------------------------------------
MEANINGLESS_PATTERNS = [
    ["their", "and"], ["there", "and"], ["they", "and"], ["them", "and"],
    ["about", "and"], ["never", "and"], ["always", "and"], ["every", "and"],
    ["would", "and"], ["because", "and"], ["should", "and"], ["will", "and"],
    ["doing", "and"], ["right", "and"], ["bullish", "and"], ["judgment", "and"],
    ["spiritual", "and"],
    ["target", "and", "waterparks"], ["images", "and", "divine"],
    ["target", "and", "amazon"], ["amazon", "and", "customer", "experience"],
    ["amazon", "and", "customer", "feedback"], ["prices", "and", "tariffs"],
    ["new", "and", "day"], ["global", "and", "debt"],
    ["nctsmtown", "and"], ["nct", "and"], ["smtown", "and"],
    ["customer", "service", "and", "never"], ["customer", "service", "and", "always"],
    ["customer", "experience", "and", "about"], ["customer", "experience", "and", "would"],
    ["customer", "experience", "and", "because"], ["customer", "service", "and", "company"],
    ["customer", "service", "and", "right"], ["customer", "experience", "and", "right"],
    ["customer", "service", "and", "doing"], ["customer", "experience", "and", "bullish"],
    ["business", "and", "customer", "experience"], ["themes", "and", "customer", "experience"],
    ["school", "and", "customer", "support"], ["bullish", "and", "customer", "experience"],
]
GENERIC_SINGLE = [
    "their", "there", "they", "them", "these", "this", "that", "new", "day",
    "global", "debt", "images", "divine", "about", "never", "always", "every",
    "all", "some", "many", "much", "more", "most", "very", "really", "quite",
    "just", "only", "also", "still", "even", "yet", "already", "nctsmtown", "nct", "smtown",
    "would", "could", "should", "will", "can", "may", "might", "must",
    "because", "since", "while", "when", "where", "what", "which", "who",
    "company", "business", "themes", "theme", "school", "awesome",
    "doing", "right", "bullish", "judgment", "spiritual", "available", "students",
]
GENERIC_FIRST = [
    "target", "amazon", "their", "there", "images", "divine", "waterparks",
    "about", "never", "always", "nctsmtown", "nct", "smtown", "would", "because",
    "should", "company", "business", "themes", "school", "doing", "right",
    "bullish", "judgment", "spiritual",
]
GENERIC_SECOND = [
    "customer service", "customer feedback", "customer experience", "delivery",
    "business", "company", "never", "always", "support", "right", "doing",
]
GENERIC_SECOND_ALONE = ["never", "always", "about", "every", "all", "some", "many", "much", "company", "business"]
GENERIC_BEFORE_EXPERIENCE = ["would", "because", "should", "business", "themes", "school"]
SMALL_WORDS = ["and", "or", "the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "by"]
TITLE_STRIP_CHARS = ".,!?;:"

# ---------------------------------------------------------------------------
# FIXED VALUES — title validation
# ---------------------------------------------------------------------------
BANNED_TITLE_WORDS = [
    "doing", "right", "bullish", "judgment", "spiritual", "available", "students", "motif", "motifs",
    "would", "could", "should", "will", "can", "may", "might", "must", "shall",
    "because", "since", "while", "when", "where", "what", "which", "who", "whom",
    "company", "business", "themes", "theme", "school", "awesome",
]
THEME_TAXONOMY = [
    "Operational Issues",
    "Multi-Aspect Feedback",
    "Customer Service Experience",
    "Service Quality",
    "Customer Support",
    "Order Fulfillment",
    "Delivery Challenges",
    "Pricing Concerns",
    "Tariff Impact",
    "Product Quality",
    "Product Availability",
    "Shopping Experience",
    "Store Visits",
    "Walmart Brand",
    "Corporate Topics",
    "Employee Relations",
    "Workplace Feedback",
    "Customer Appreciation",
    "Positive Feedback",
    "Product Reviews",
    "Recommendations",
    "American Products",
    "International Products",
    "Food Products",
    "Shrimp Product Quality",
    "Digital Experience",
]
DEFAULT_TITLE = "Customer Service Experience Concerns"

# ---------------------------------------------------------------------------
# FIXED VALUES — keyword → business term dictionary for fallback titles
# ---------------------------------------------------------------------------
KEYWORD_TITLES = {
    "service": "Customer Service Experience", "support": "Customer Support", "help": "Customer Support",
    "staff": "Staff Interaction", "employee": "Employee Relations", "worker": "Workplace Feedback",
    "employees": "Employee Relations", "people": "Staff Interaction",
    "price": "Pricing Concerns", "pricing": "Pricing Concerns", "cost": "Pricing Concerns",
    "tariff": "Tariff Impact", "tariffs": "Tariff Impact", "prices": "Pricing Concerns",
    "delivery": "Delivery Challenges", "shipping": "Shipping Issues", "fulfillment": "Order Fulfillment",
    "order": "Order Fulfillment", "purchase": "Order Fulfillment", "orders": "Order Fulfillment",
    "return": "Returns", "refund": "Returns", "exchange": "Returns",
    "product": "Product Quality", "item": "Product Quality", "quality": "Product Quality",
    "products": "Product Quality", "items": "Product Quality",
    "shopping": "Shopping Experience", "store": "Store Visits", "visit": "Store Visits",
    "customer": "Customer Experience", "experience": "Customer Experience",
    "walmart": "Walmart Brand", "brand": "Corporate Topics", "corporate": "Corporate Topics",
    "issue": "Operational Issues", "problem": "Operational Issues", "concern": "Customer Concerns",
    "issues": "Operational Issues", "problems": "Operational Issues", "concerns": "Customer Concerns",
    "availability": "Product Availability", "stock": "Product Availability", "inventory": "Product Availability",
    "app": "Digital Experience", "website": "Digital Experience", "online": "Digital Experience",
    "review": "Product Reviews", "recommendation": "Product Recommendations", "reviews": "Product Reviews",
    "american": "American Products", "indian": "International Products",
    "shrimp": "Shrimp Product Quality", "food": "Food Products",
    "awesome": "Customer Appreciation", "positive": "Positive Feedback", "appreciation": "Customer Appreciation",
    "feedback": "Positive Feedback", "multi": "Multi-Aspect Feedback",
}
CONCERN_TERMS = ["Customer Service Experience", "Service Quality"]
ISSUE_TERMS = ["Order Fulfillment", "Product Quality"]
STANDALONE_TERMS = ["Pricing Concerns", "Product Availability"]

# FIXED VALUES — prompt keyword whitelists and defaults
PROMPT_BUSINESS_TERMS = [
    "service", "support", "price", "pricing", "delivery", "order", "product",
    "quality", "shopping", "store", "customer", "staff", "return", "availability",
    "app", "website", "shipping", "fulfillment", "tariff", "cost", "employee",
    "experience", "issue", "problem", "concern", "review", "recommendation",
    "shrimp", "food", "employees", "prices", "tariffs",
]
PROMPT_DEFAULT_TERMS = ["customer service", "product quality", "order fulfillment", "shopping experience"]
SUMMARY_BUSINESS_TERMS = [
    "service", "support", "price", "pricing", "delivery", "order", "product",
    "quality", "shopping", "store", "customer", "staff", "return", "availability",
]
SUMMARY_DEFAULT_TERMS = ["customer service", "product quality", "shopping experience", "order fulfillment"]
SUMMARY_PROMPT_DEFAULT_TERMS = ["customer", "service", "product"]

# ---------------------------------------------------------------------------
# FIXED VALUES — theme-name similarity synonym pairs
# ---------------------------------------------------------------------------
SYNONYM_PAIRS = [
    ("availability", "stock"), ("stock", "inventory"), ("product", "item"),
    ("order", "purchase"), ("fulfillment", "delivery"), ("processing", "handling"),
    ("customer", "client"), ("service", "support"), ("issue", "problem"),
    ("concern", "issue"), ("problem", "issue"), ("complaint", "issue"),
    ("experience", "interaction"), ("humor", "funny"), ("joke", "humor"),
    ("availability", "concern"), ("stock", "concern"), ("product", "availability"),
    ("delivery", "fulfillment"), ("pricing", "tariff"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — display name overrides (C15): lower-cased key → display name
# ---------------------------------------------------------------------------
THEME_DISPLAY_OVERRIDES = {
    "Hidden and Customer Support": "Hidden Charges and Customer Support",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — template texts
# ---------------------------------------------------------------------------
THEME_SUMMARY_TAIL = "Customers are discussing various aspects related to this topic."
THEME_SUMMARY_TAIL_LONG = (
    "Customers are discussing various aspects related to this topic. "
    "The discussions cover different perspectives and experiences."
)
EMPTY_PERIOD_SUMMARY = "No tweets in the selected period."

# ---------------------------------------------------------------------------
# FIXED VALUES — Spark ML's default English stop words
# ---------------------------------------------------------------------------
ENGLISH_STOPWORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())

# ---------------------------------------------------------------------------
# FIXED VALUES — what a generator is asked for a theme (C17): instruction and request
# ---------------------------------------------------------------------------
TITLE_INSTRUCTION = (
    "You are a professional retail insights analyst creating theme names for Walmart customer feedback analysis reports. "
    "Your theme names will be used in executive presentations and stakeholder reports. "
    "Generate ONLY professional, business-appropriate theme names that generalize customer concerns into meaningful business categories. "
    "IGNORE specific brand names, usernames, or mentions - focus on the UNDERLYING BUSINESS THEME. "
    "Use only the approved taxonomy terms when naming themes. "
    "Approved taxonomy terms:\n" + "\n".join(f"- '{term}'" for term in THEME_TAXONOMY) + "\n"
)
TITLE_REQUEST = """\
Based on customer feedback keywords and samples, create ONE professional theme name for a Walmart customer insights report.

CRITICAL INSTRUCTIONS:
1. IGNORE ALL usernames, mentions, profanity, and noise words (like 'sentomcotton', 'fuck', 'matt_vanswol', 'awsten', 'spencerhakimian')
2. If you see profanity, usernames, or meaningless words in keywords, COMPLETELY IGNORE them
3. Focus ONLY on the BUSINESS THEME or CUSTOMER CONCERN from the sample tweets
4. NEVER create generic names like 'Target and Customer Experience', 'Prices and Pricing', 'New and Day', or 'Global and Debt'
5. NEVER include usernames, profanity, or competitor names unless it's a legitimate business comparison
6. Use DISTINCT business categories - avoid repeating the same category in different themes
7. If keywords are all noise, infer the theme from sample tweets (e.g., if tweets mention delivery issues → 'Order Fulfillment and Delivery Challenges')

REQUIRED FORMAT:
'[Specific Business Category] and [Specific Customer Concern/Focus]'

GOOD EXAMPLES (use these EXACT formats as your guide - these are the REQUIRED style):
- 'Operational Issues and Multi-Aspect Feedback'
- 'Customer Service Experience Concerns'
- 'Shrimp Product Quality and Availability'
- 'Shopping Experience and Store Visits'
- 'Walmart Brand and Corporate Topics'
- 'Pricing Concerns and Tariff Impact'
- 'Order Fulfillment Issues'
- 'American Product Availability Concerns'
- 'Service Quality and Support'
- 'Product Reviews and Recommendations'
- 'Customer Appreciation and Feedback'
- 'Employee Relations and Workplace Feedback'

NOTE: Themes can be:
- '[Business Category] and [Specific Focus]' (e.g., 'Order Fulfillment and Delivery Challenges')
- '[Business Category] [Issue Type]' (e.g., 'Customer Service Experience Concerns', 'Order Fulfillment Issues')
- '[Product Category] [Quality/Availability]' (e.g., 'Shrimp Product Quality and Availability')

BAD EXAMPLES (DO NOT create these - these are REAL bad examples):
- 'Would and Customer Experience' (generic auxiliary verb, meaningless)
- 'Because and Customer Experience' (generic conjunction, meaningless)
- 'Customer Service and Company' (too generic, 'company' adds no value)
- 'Business and Customer Experience' (too generic, 'business' is too broad)
- 'Themes and Customer Experience' (meta word 'themes', meaningless)
- 'School and Customer Support' (unrelated topic 'school', not retail-relevant)
- 'Sentomcotton and Customer Feedback' (contains username)
- 'Fuck and Fucking' (contains profanity)
- 'Target and Awsten' (contains username/competitor)
- 'Their and Customer Service' (generic pronoun, meaningless)
- 'About and Customer Experience' (generic word 'about', meaningless)
- 'Customer Service and Never' (generic adverb 'never', meaningless)
- 'Nctsmtown and Customer Experience' (brand/username, not business-relevant)
- 'Target and Waterparks' (unrelated, not business-relevant)
- 'Amazon and Customer Experience' (too generic, competitor name)
- 'Prices and Tariffs' (redundant, both mean pricing)

STRICT RULES:
1. Must be 4-7 words total
2. Use Title Case
3. Use DISTINCT business categories - each theme should cover a different aspect
4. Be SPECIFIC - 'Pricing Concerns and Tariff Impact' not 'Prices and Tariffs' (redundant)
5. NEVER use: 'user', 'tweet', 'feedback', 'topics' as main terms
6. NEVER use: generic words like 'their', 'there', 'they', 'about', 'never', 'always', 'would', 'because', 'should', 'company', 'business', 'themes', 'school'
7. NEVER use: auxiliary verbs or conjunctions (like 'Would', 'Because', 'Should', 'Will', 'Can')
8. NEVER use: brand names or usernames (like 'Nctsmtown', 'Target', 'Amazon' unless it's a legitimate business comparison)
9. NEVER use: competitor names alone (like 'Target and Waterparks' or 'Amazon and Customer Experience')
10. NEVER create: redundant combinations (e.g., 'Prices and Tariffs' - both mean pricing)
11. NEVER use: generic adverbs, pronouns, or auxiliary verbs as theme parts
12. NEVER use: meta words like 'themes', 'theme', or unrelated topics like 'school'
13. NEVER use: overly broad words like 'company', 'business' as standalone theme parts
14. Focus on: Service, Pricing, Products, Delivery, Experience, Quality, Availability, Staff, Returns, App, etc.
15. Make each theme UNIQUE and MEANINGFUL for business decisions
16. Each part of the theme (before and after 'and') must be a SPECIFIC business concept
17. Both parts must be NOUNS or NOUN PHRASES describing business categories, NOT generic words, verbs, or adverbs
18. Use SPECIFIC business terminology: 'Operational Issues', 'Service Quality', 'Product Availability', 'Pricing Concerns', etc.

Keywords (filtered, ignore noise): {kws}

Generate ONE professional, specific theme name. Return ONLY the name. No quotes, no explanations."""
TITLE_SAMPLES_HEAD = "\n\nSample customer feedback:\n"
TITLE_REQUEST_TAIL = "Return ONLY the theme name. No explanations, no quotes. IGNORE any specific usernames or brand mentions in the keywords."
SUMMARY_INSTRUCTION = (
    "You are a retail insights analyst. Write 3-4 lines describing the theme for a Walmart stakeholder. "
    "Focus on what customers are discussing, not sentiment counts or action items. Be descriptive and informative. "
    "IGNORE specific usernames, brand mentions, or noise words - focus on the business theme."
)
SUMMARY_REQUEST = """\
Theme name: {title}
Top keywords (filtered): {kws}
Examples (up to 2): {examples}
Output: 3-4 lines describing what customers are discussing in this theme. \
Focus on the BUSINESS THEME (e.g., customer service, product quality, pricing, delivery, etc.). \
Do NOT mention specific usernames, brand names, or noise words. Do not mention sentiment counts or suggest actions."""
