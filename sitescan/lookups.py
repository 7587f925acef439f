"""Fixed lookup values used by the operators.

Everything here is data: word lists, literal signatures and patterns. The
patterns are written so that one text works in Java's regex engine (Spark)
and in RE2; look-around is added by the functions that need it.
"""

from .samples import LANGUAGES

# White space and word characters, spelled out so that every engine agrees.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\p{L}\p{N}_]"

# Names a URL column may have, best first.
URL_COLUMNS = (
    "url", "URL", "urls", "URLs",
    "website", "Website", "websites", "Websites",
    "domain", "Domain", "domains", "Domains",
    "link", "Link", "links", "Links",
)

# Cell texts that stand for "no URL".
EMPTY_URL_WORDS = ("", "nan", "none", "null")

# Words too generic to make a pattern of their own.
GENERIC_QUERY_WORDS = ("blog", "news", "site", "web")

# Hosts that are never a site to profile.
NOISE_DOMAINS = (
    "youtube.com", "twitter.com", "x.com", "facebook.com",
    "instagram.com", "linkedin.com", "reddit.com", "pinterest.com",
    "tiktok.com", "wikipedia.org", "amazon.com",
)

# Publishing systems and the literal texts that give them away.
CMS_SIGNATURES = (
    ("WordPress", ("/wp-content/", "/wp-includes/", 'generator" content="WordPress')),
    ("Ghost", ("/ghost/", "ghost.io", 'generator" content="Ghost')),
    ("Webflow", ("webflow.com", "data-wf-", 'generator" content="Webflow')),
    ("Squarespace", ("squarespace.com", "static.squarespace", 'generator" content="Squarespace')),
    ("Wix", ("static.wixstatic.com", "wix.com/lpviral", "_wix_")),
    ("Shopify", ("cdn.shopify.com", "myshopify.com", "Shopify.theme")),
    ("HubSpot", ("hs-scripts.com", "hubspot.com/", "hbspt.")),
    ("Substack", ("substack.com", "substackcdn.com")),
    ("Medium", ("medium.com/_/", "cdn-client.medium.com")),
    ("Blogger", ("blogger.com", "blogspot.com", "www.blogger.com/static")),
)

# Elements whose subtree is not content.
BOILERPLATE_TAGS = (
    "script", "style", "nav", "footer", "header",
    "aside", "noscript", "iframe", "form",
)

# Id and class fragments that mark the content element.
CONTENT_ID = r"(?i)content|main|post|article"
CONTENT_CLASS = r"(?i)content|main|post|article|entry"

# Meta tags that may hold an author, best first.
AUTHOR_META = (
    ("property", "article:author"),
    ("property", "og:article:author"),
    ("name", "author"),
    ("name", "twitter:creator"),
    ("name", "sailthru.author"),
)

# Byline selectors, best first, as (kind, argument).
#   rel     a[rel="x"]          attr    [class*="x"] or [id*="x"]
#   class   .x                  within  .x .y
BYLINE_SELECTORS = (
    ("rel", "author"),
    ("attr", ("class", "author")),
    ("attr", ("class", "byline")),
    ("attr", ("class", "writer")),
    ("attr", ("class", "journalist")),
    ("attr", ("id", "author")),
    ("attr", ("id", "byline")),
    ("within", ("vcard", "fn")),
    ("class", "p-author"),
    ("class", "entry-author"),
    ("class", "post-author"),
    ("class", "article-author"),
)

# Words that never occur in a person's name.
NON_NAME_WORDS = (
    "reader", "editor", "staff", "team", "contributor", "admin", "user",
    "member", "subscriber", "guest", "updated", "published", "posted",
    "comments", "shares", "views", "minutes", "hours", "days", "ago",
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
# What a byline begins with, and the letters of a name.
BYLINE_PREFIX = rf"^(?:by|written by|posted by|author(?::|{WS})?){WS}+"
NAME_LETTERS = r"^[A-Za-z\x{c0}-\x{24f}\x{400}-\x{4ff}'\-\. ]{2,50}$"

# Spellings that hide an address, and what they stand for.
#   (mark, replacement, white space around it is required)
OBFUSCATIONS = (
    (r"\[at\]", "@", False),
    (r"\(at\)", "@", False),
    (r"at", "@", True),
    (r"\[dot\]", ".", False),
    (r"\(dot\)", ".", False),
)

# An address, and the shape a valid address must have.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
EMAIL_FORMAT = rf"^{EMAIL}$"

# Addresses that are not contacts.
EMAIL_BLOCKLIST = (
    r"\.(?:png|jpg|jpeg|gif|svg|webp|webm|css|js|json|xml|php|asp)$",
    r"@example\.",
    r"@domain\.",
    r"@yourdomain\.",
    r"@sentry\.",
    r"\.ingest\.sentry\.io$",
    r"\.ingest\.us\.sentry\.io$",
    r"@[a-z]\.dropbox\.com$",
    r"noreply@",
    r"no-reply@",
    r"donotreply@",
    r"@\d+\.\d+",
    r"\.{2,}",
)

# Local parts and nearby words that suggest a contact address.
CONTACT_LOCAL_PARTS = (
    "contact", "hello", "info", "press", "editor", "media", "advertise", "tip", "tips",
)
CONTACT_KEYWORDS = (
    "contact", "editor", "author", "press", "media", "adverti", "submit",
    "pitch", "tip", "hello", "info", "reach",
)

# Site types, in their canonical spelling.
SITE_TYPES = ("Blog", "News", "Business", "E-commerce", "Portfolio", "Unknown")

# The output columns, as (field, heading).
RESULT_COLUMNS = (
    ("url", "URL"),
    ("niche", "Niche/Topic"),
    ("site_type", "Site Type"),
    ("language", "Language"),
    ("author", "Author/Editor"),
    ("email", "Email"),
    ("email_valid", "Email Valid"),
    ("confidence_niche", "Conf. Niche (%)"),
    ("confidence_type", "Conf. Type (%)"),
    ("confidence_author", "Conf. Author (%)"),
    ("cms", "CMS"),
    ("status", "Status"),
    ("error", "Error"),
)

# Own choice: scripts that settle the language on their own, strongest first: code, name, letters.
# Languages that share a script are told apart by `samples.LANGUAGES`.
_SCRIPTS = (
    ("ja", "Japanese", r"[\x{3040}-\x{30ff}]"),
    ("ko", "Korean", r"[\x{ac00}-\x{d7af}]"),
    ("zh", "Chinese", r"[\x{4e00}-\x{9fff}]"),
    ("el", "Greek", r"[\x{370}-\x{3ff}]"),
    ("he", "Hebrew", r"[\x{590}-\x{5ff}]"),
    ("th", "Thai", r"[\x{e00}-\x{e7f}]"),
    ("bn", "Bengali", r"[\x{980}-\x{9ff}]"),
    ("pa", "Punjabi", r"[\x{a00}-\x{a7f}]"),
    ("gu", "Gujarati", r"[\x{a80}-\x{aff}]"),
    ("ta", "Tamil", r"[\x{b80}-\x{bff}]"),
    ("te", "Telugu", r"[\x{c00}-\x{c7f}]"),
    ("kn", "Kannada", r"[\x{c80}-\x{cff}]"),
    ("ml", "Malayalam", r"[\x{d00}-\x{d7f}]"),
)
LANGUAGE_SCRIPTS = tuple((code, letters) for code, _, letters in _SCRIPTS)
LANGUAGE_NAMES = (*((code, name) for code, (name, _) in LANGUAGES.items()), *((code, name) for code, name, _ in _SCRIPTS))

# Own choice: words that speak for a site type or a topic. Ties go to the
# label listed first.
SITE_TYPE_WORDS = (
    ("Blog", ("blog", "blogs", "post", "posts", "blogger", "archives", "diary", "journal")),
    ("News", ("news", "breaking", "headline", "headlines", "reporter", "newspaper", "press",
              "politics")),
    ("Business", ("company", "services", "solutions", "clients", "team", "pricing",
                  "enterprise", "consulting")),
    ("E-commerce", ("shop", "cart", "checkout", "buy", "store", "product", "products",
                    "shipping", "cheap")),
    ("Portfolio", ("portfolio", "projects", "designer", "photographer", "resume", "gallery",
                   "illustrator", "freelance")),
)
NICHE_WORDS = (
    ("Personal Finance", ("finance", "money", "budget", "investing", "savings", "loan",
                          "mortgage", "credit")),
    ("Food & Recipes", ("food", "recipe", "recipes", "cooking", "kitchen", "baking",
                        "restaurant")),
    ("Travel Blog", ("travel", "trip", "hotel", "flights", "destination", "tourism")),
    ("B2B Software", ("software", "saas", "api", "platform", "cloud", "developer")),
    ("Health & Pharmacy", ("health", "pills", "pharmacy", "medicine", "fitness", "viagra")),
    ("Online Gambling", ("casino", "win", "poker", "betting", "lottery", "jackpot")),
    ("Digital Marketing", ("marketing", "seo", "ads", "spam", "campaign", "click", "free")),
)
