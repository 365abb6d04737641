"""Fixed values that results depend on, in one place."""

# Hosts and domains that are never a company's own site.
BLOCKED_DOMAINS = ["apple.com", "apps.apple.com", "cdn.jsdelivr.net", "cloudflare.com", "facebook.com", "github.com", "github.io", "google.com", "googletagmanager.com", "instagram.com", "linkedin.com", "maps.google.com", "medium.com", "notion.site", "reddit.com", "twitter.com", "x.com", "youtube.com"]
BLOCKED_HOST_PARTS = ["accounts.", "api.", "app.", "blog.", "cdn.", "docs.", "help.", "login.", "status.", "support."]
DIRECTORY_DOMAINS = ["amazon.com", "angel.co", "apollo.io", "apps.apple.com", "bbb.org", "bloomberg.com", "builtwith.com", "businesswire.com", "capterra.com", "clearbit.com", "crunchbase.com", "dnb.com", "f6s.com", "g2.com", "getapp.com", "glassdoor.com", "indeed.com", "leadiq.com", "manta.com", "owler.com", "pitchbook.com", "play.google.com", "prnewswire.com", "producthunt.com", "rocketreach.co", "semrush.com", "similarweb.com", "softwareadvice.com", "tracxn.com", "trustpilot.com", "wellfound.com", "wikipedia.org", "wikimedia.org", "ycombinator.com", "yelp.com", "zoominfo.com"]
AGGREGATOR_STEMS = ["fordaq", "europages", "kompass", "go4worldbusiness", "globalwood", "bulurum", "isdunyasirehberi", "tradeindia", "exporthub", "alibaba", "made-in-china", "globalsources", "indiamart", "thomasnet", "ec21", "tradekey", "yellowpages", "telecontact", "kerix", "kerix-export", "goafricaonline", "enfrecycling"]
AGGREGATOR_PHRASES = r"(?:b2b (?:marketplace|platform)|marketplace for|business directory|company directory|trade directory|suppliers? and buyers?|buyers? and suppliers?|list of (?:companies|suppliers|manufacturers)|connect(?:s|ing)? (?:buyers|businesses)|directory of (?:professionals|companies|businesses|suppliers|manufacturers)|yellow ?pages|pages jaunes|annuaire|directorio de empresas|firmenverzeichnis|firma rehberi)"
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "govt", "edu", "ac", "mil", "go", "or", "ne", "gob", "gouv"]

# Paths.
SITE_PATHS = ["", "/about", "/customers", "/case-studies", "/blog", "/careers", "/pricing"]
CONTACT_PATHS = ["", "/about", "/contact", "/team", "/founders", "/company", "/press", "/security", "/legal", "/imprint", "/careers"]
SEARCH_TEMPLATES = ["site:{domain} contact", "site:{domain} team OR people", "site:{domain} partnerships OR partner", "site:{domain} developer relations OR devrel", "site:{domain} growth OR marketing", '"{company}" "{domain}" email']

# Local parts of addresses.
ROLE_PREFIXES = ["contact", "founders", "growth", "hello", "hi", "info", "marketing", "partner", "partnerships", "press", "product", "sales", "security", "support", "team", "vulnerability-disclosure", "responsible-disclosure", "abuse", "admin", "billing", "careers", "compliance", "enquiries", "enquiry", "feedback", "general", "help", "hr", "jobs", "legal", "media", "newsletter", "noreply", "no-reply", "office", "postmaster", "pr", "privacy", "webmaster"]
HIGH_VALUE_PREFIXES = ["partnerships", "partner", "growth", "marketing", "product", "sales", "team"]
LOW_VALUE_PREFIXES = ["founders", "hello", "hi", "contact", "press", "support", "info"]
COMPANY_EMAIL_RANK = {"partnerships": 95, "partner": 93, "bd": 90, "business-development": 90, "growth": 86, "marketing": 84, "sales": 82, "hello": 70, "contact": 66, "info": 64, "enquiries": 62, "enquiry": 62, "team": 60, "press": 50, "media": 48, "support": 40}
PEOPLE_EMAIL_RANK = {"partnerships": 84, "partner": 82, "growth": 80, "marketing": 78, "product": 76, "sales": 74, "team": 62, "hello": 58, "hi": 55, "contact": 54, "founders": 46, "press": 42, "support": 35, "info": 30}

# Word patterns of the scores. \b stands for a word boundary in both regex dialects that are used here.
B2B_SIGNAL = r"(?i)\b(?:api|developer|developers|engineering|observability|analytics|crm|workflow|workflows|infrastructure|security|database|data|agent|agents|sdk|cloud|enterprise|saas|support|automation|billing|auth|monitoring)\b"
NOISY_PRODUCT = r"(?i)\b(?:directory|directories|backlink|submit your|submit ai|resume|cv|video generator|audio tool|vocal remover|asmr|karaoke|wallpaper|headshot|logo generator|image generator|tiktok|instagram)\b"
RELEVANT_ROLE = r"(?i)\b(?:partnerships?|partner|growth|marketing|product marketing|developer relations|devrel|community|sales|business development|customer success|recruiting|talent|engineering|developer advocate)\b"
EXEC_ROLE = r"(?i)\b(?:founder|co-founder|ceo|cto|cfo|coo|president)\b"
FACT_VERBS = r"(?i)\b(?:builds?|helps?|offers?|provides?|enables?|automates?|connects?|supports?|serves?|works with|integrates?|protects?|manages?|tracks?|uses?|creates?|delivers?|speciali[sz]es)\b"
FACT_NOISE = r"(?i)\b(?:cookie|privacy policy|terms of service|all rights reserved|sign up|log in|subscribe|newsletter|book a demo|get started|upgrade to|use .* for free|start for free|try for free|find out .*cost|pricing|unlimited issues)\b"
CALL_TO_ACTION = r"(?i)^(?:visit|visit website|website|open|learn more|view|go|launch|try it|demo)\s*(?:→|->)?$"
LEGAL_SUFFIX = r"(?i)\s*\b(?:inc\.?|ltd\.?|llc\.?|corp\.?|co\.?|plc\.?|gmbh|s\.?a\.?|pvt\.?\s*ltd\.?|limited|incorporated|corporation|company)\s*$"
GENERIC_PHRASES = ["i hope this email finds you well", "touch base", "synergy", "game-changer", "cutting-edge", "streamline", "reaching out", "i came across", "i was impressed", "i'd love to"]
BAD_PERSON_WORDS = ["About", "All", "And", "Careers", "Company", "Contact", "Co", "Home", "Legal", "Needle", "Press", "Privacy", "Processing", "Read", "Run", "Security", "Support", "Team", "Terms", "The", "We"]
LEAK_SIGNS = r"(?i)(?:\w+_\w+\s*[:=]|/[a-z]/\d+/|\.json\b|max_tokens|temperature|top_[kp]|frequency|system_name|binary_name|latency|cache|PARAMS\s*:)"

# What profiles say of moves, of free time and of periods, and where profiles are.
MOVE_PHRASES = ["now at", "now with", "now @", "joined", "moved to", "currently at", "currently with", "currently @"]
FREE_PHRASES = ["opentowork", "open to work", "laid off", "looking for", "seeking.*opportunit", "between roles", "available for hire", "freelanc", "independent consultant"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
PROFILE_PATH = "linkedin.com/in"

# How companies name their seat, and whose seat is not theirs.
SEAT_WORDS = ["based", "headquartered", "headquarters", "headquarter", "head offices", "head office", "hq", "registered", "incorporated"]
MARKET_WORDS = ["customers?", "clients?", "buyers?", "partners?", "distributors?", "importers?", "resellers?", "companies", "businesses", "firms", "manufacturers", "suppliers", "organi[sz]ations", "enterprises", "brands"]
# Short words of other languages that are no terms.
NATIVE_FUNCTION_WORDS = ["pour", "avec", "dans", "sans", "sous", "chez", "leur", "elles", "vers", "para", "como", "sobre", "entre", "desde", "hasta", "unas", "unos", "della", "delle", "degli", "dello", "dalla", "nella", "alla", "eine", "einer", "eines", "einem", "einen", "nach", "über", "unter", "voor", "naar", "deze", "onder", "için", "veya"]
# Queries for the companies of a region, and what a useful page of a company is called.
REGION_TEMPLATES = ["{icp} companies in {region}", "list of {icp} in {region}", "top {icp} {region}", "{icp} {region} contact email", "{icp} association {region} members"]
PAGE_HINTS = ["about", "business-development", "careers", "community", "company", "contact", "developer", "developers", "devrel", "growth", "marketing", "partners", "partnership", "partnerships", "people", "press", "sales", "security", "team"]
PAGE_SKIPS = ["login", "signin", "sign-up", "signup", "privacy", "terms", "cookie"]
FILE_ENDS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".zip"]

# Roles of persons, those that are written to first, and the parts of a mail that are not its text.
ROLES = ["founder", "co-founder", "ceo", "cto", "cfo", "coo", "cpo", "president", "head of [a-z]+", "vp of [a-z]+", "director of [a-z]+", "developer relations", "devrel", "growth", "marketing", "product", "partnerships?", "community", "sales", "business development", "customer success", "recruiting", "talent"]
TARGET_ROLES = ["market", "partner", "growth", "customer success", "business develop", "developer relat", "devrel", "community", "sales", "account", "outreach", "demand gen", "talent", "recruiting", "people ops"]
REMARKS = ["this response", "this email", "here is", "i hope this", "let me know if", "note:", "the above", "i've written", "i've crafted", "i've composed", "word count"]
GREETINGS = ["dear", "hi", "hello", "hey"]
SIGN_OFFS = ["best", "regards", "cheers", "thanks", "thank you", "sincerely", "warm regards"]
SUBJECT_MARKS = ["subject:", "subject line:", "re:"]

# Words of target profiles.
GENERIC_TERMS = ["startup", "startups", "company", "companies", "tool", "tools", "early", "software", "platform", "business"]
STOPWORDS = ["and", "for", "the", "with", "that", "this"]
QUALIFIER_MARKERS = ["for", "serving", "targeting", "helping", "catering", "in", "within", "across", "near", "at", "around", "from", "to", "toward", "towards", "based", "located", "operating", "with", "without", "via", "by", "who", "that", "which", "whose", "focused", "focusing", "specializing", "specialising", "on"]
CORE_LINKERS = ["of"]
TRANSPARENT = ["and", "or", "the", "a", "an", "&"]

# Columns of the written tables.
COMPANY_COLUMNS = ["email", "name", "company", "website", "match_confidence", "verification", "country", "region_fit", "company_email", "email_type", "phone", "address", "linkedin_company_url", "partnership_channel", "size_tier", "icp_score", "matched_terms", "website_status", "company_summary", "personalization_facts", "source_urls", "personalization_score", "discovery_channel", "discovery_source_url", "discovered_at", "lead_score", "lead_score_reasons", "quality_warnings"]
PEOPLE_COLUMNS = ["contact_name", "contact_role", "contact_linkedin", "contact_stale_warning"]
# Beginnings of lines that are furniture of a user interface, as patterns.
JUNK_LINES = [
    "skip to", "cookie", "accept all", "sign up", "log ?in", "sign ?in", "get started", "free trial", "subscribe", "download", "menu", "toggle", "©", r"\d+ min ago", "just now", "yesterday",
    "created the issue", "moved from", "added the label", r"@\w", r"fig \d", "render ", r"thinking\.\.\.", "on it!", "kicked off", "searching for", "locating ", "examining ", r"\$ ", "commit ", "pushed ", "merged ",
    "activity", "triage ", "codex", "todo", "in progress", "high", "low", "medium", r"cycle \d", "labelscycle", r"project\b",
]

# Words in headings of encyclopedia lists whose entries are no active companies, and words of names that are none.
WIKI_SKIPPED = ["defunct", "former", "closed", "merged", "dissolved", "renamed", "regulator", "regulators", "association", "associations", "see also", "references", "external links", "further reading", "notes", "bibliography"]
NO_COMPANY = r"(?i)\b(authority|regulator|ministry|commission|federation|institute|academy|index|list of|category|wikipedia|template|portal|see also)\b"

# Beginnings of what stands in a profile's title where a company would and is a role.
COMMON_ROLES = ["engineer", "developer", "designer", "manager", "director", "analyst", "consultant", "scientist", "architect", "lead", "head", "chief", "vp", "president", "founder", "ceo", "cto", "cfo", "coo", "intern", "associate", "coordinator", "specialist", "strategist", "officer", "advisor", "professor", "researcher", "student", "freelanc"]
