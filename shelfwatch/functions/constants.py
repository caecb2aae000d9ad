"""Fixed values. They define results, so they are kept as plain text in one place."""

# --- price text: symbols are tried in this order, the first one contained wins -----------------------------
CURRENCY_SYMBOLS = (
    ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₩", "KRW"), ("₪", "ILS"), ("₫", "VND"),
    ("฿", "THB"), ("zł", "PLN"), ("kr", "SEK"), ("CHF", "CHF"), ("CAD", "CAD"), ("AUD", "AUD"), ("NZD", "NZD"),
)
# A code in the text overrides a symbol. Tried in this order.
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "INR", "KRW", "CAD", "AUD", "CHF", "NZD", "SEK", "PLN")

# --- stock text: out-of-stock phrases are tested first ------------------------------------------------------
OUT_OF_STOCK_PHRASES = ("out of stock", "unavailable", "sold out", "out-of-stock")
IN_STOCK_PHRASES = ("in stock", "available", "add to cart", "buy now", "in-stock")

# --- landing --------------------------------------------------------------------------------------------
IGNORED_COLLECTIONS = ("all", "frontpage", "home-page", "new", "best-sellers")
ENGLISH_CATEGORIES = {
    "ماب السرقة": "Steal a Brainrot",
    "روبلوكس": "Roblox",
    "سايلور بيس": "Sailor Piece",
    "ماب النباتات ضد البراينروت": "Plants vs Brainrot",
    "ماب المزرعة": "Grow a Garden",
    "ماب ادوبت مي": "Adopt Me",
    "روبوكس": "Robux",
    "الهروب من تسونامي": "Escape Tsunami",
}
# Patterns of serialized page state, all case-insensitive with dot matching newlines.
STATE_TITLE = r'title:"([^"]+)"'
STATE_PRICE = r'price:\$R\[\d+\]=\{amount:"([^"]+)"'
STATE_CURRENCY = r'currencyCode:"([A-Z]{3})"'
STATE_IMAGE = r'url:"(https?://cdn\.shopify\.com/[^"]+)"'
STATE_PRODUCT_ID = r"gid://shopify/Product/(\d+)"
STATE_VARIANT_ID = r"gid://shopify/ProductVariant/(\d+)"
STATE_AVAILABLE = r"availableForSale:(!0|!1|true|false)"
STATE_TYPE = r'productType:"([^"]*)"'
JSONLD_BLOCK = r"""<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
SITEMAP_LOC = r"<loc>\s*([^<]+?)\s*</loc>"
COLLECTION_PATH = r"/collections/([A-Za-z0-9][A-Za-z0-9_-]*)"
CATEGORY_ELEMENT = r"""<salla-products-list\b[^>]*\bsource-value=["'](\d+)["']"""
CATEGORY_PATH = r"/c(\d+)"

# --- onboarding -----------------------------------------------------------------------------------------
CATALOG_CONFIG = {"discover_collections": "true", "include_all_products": "true"}
DEFAULT_COMPETITORS = (
    ("BloxCrew", "https://bloxcrews.com/"),
    ("Bloxy Store", "https://bloxystores.com/"),
    ("PetPatch.GG", "https://petpatch.gg/"),
    ("Shopbloxs", "https://shopbloxs.com/"),
    ("Luger.GG", "https://luger.gg/"),
    ("BuyBlox", "https://buyblox.gg/"),
)

# --- change detection -----------------------------------------------------------------------------------
MISSES_UNTIL_REMOVED = 3
PRICE_EVENT_TYPES = ("price_increase", "price_decrease", "price_changed")

# --- market identity ------------------------------------------------------------------------------------
MUTATION_PHRASES = (
    "yin yang", "blood moon", "bloodrot", "candy", "celestial", "corrupted", "crystal", "cursed", "cyber", "diamond",
    "divine", "electric", "galaxy", "gold", "golden", "hacker", "lava", "magma", "radioactive", "rainbow", "shadow",
)
STAT_TOKENS = (
    "s", "sec", "second", "seconds", "m", "b", "k", "t", "qn", "qns", "best", "game", "in", "read", "description", "plus",
)
MUTATION_MARKERS = ("brainrot", "steal a brainrot", "escape tsunami")
DESCRIPTOR_TOKENS = ("knife", "knive", "knives", "gun", "guns", "weapon", "weapons", "godly", "mm2")

# --- search ---------------------------------------------------------------------------------------------
SEARCH_THRESHOLD = 0.34
COMPARE_THRESHOLD = 0.86

# --- reporting ------------------------------------------------------------------------------------------
SALES_PERIOD_DAYS = {"day": 1, "week": 7, "month": 30}
PRICE_SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}
EXPORT_FIELDS = (
    "competitor_name", "competitor_base_url", "collection_url", "category", "title", "price", "currency",
    "stock_status", "sku", "external_id", "product_url", "image_url", "scraped_at",
)
