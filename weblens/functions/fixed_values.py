"""Word lists, patterns and constants that results depend on.

Everything in this module is plain data in matching order (first match wins
where a list is ordered).  Code elsewhere only reads it; callers may pass their
own lists to override any of it.
"""

# --- fixed values: visit and request windows, seconds -----------------------
VISIT_GAP = 1800
DOUBLE_LOAD_GAP = 5
REDIRECT_GAP = 3

# --- fixed values: extensions that make a request a static file --------------
STATIC_EXTENSIONS = (
    "css js mjs map png jpg jpeg gif webp avif svg ico bmp tif tiff woff woff2 ttf otf eot "
    "mp4 webm mov avi mp3 ogg wav pdf zip rar 7z gz txt xml json csv doc docx xls xlsx ppt pptx"
).split()
MEDIA_EXTENSIONS = "png jpg jpeg gif webp avif svg ico bmp".split()
DOCUMENT_EXTENSIONS = "pdf zip rar 7z doc docx xls xlsx ppt pptx".split()

# --- fixed values: declared robots, (pattern, family, category), first match wins
SEARCH, ADS, SCRIPT = "search engine", "ads and analytics", "scripts and libraries"
AI_TRAIN, AI_USER, AI_INDEX = "AI training", "AI user request", "AI search index"
SEO, PREVIEW, MONITOR = "SEO service", "link preview", "monitoring"
GOOGLE_SVC, OTHER_BOTS, WEB_ARCHIVE = "Google services", "other bots", "web archive"
ROBOT_FAMILIES = [
    (r"YandexBot|YandexMobileBot", "YandexBot", SEARCH),
    (r"YandexRenderResourcesBot", "YandexRenderResourcesBot", SEARCH),
    (r"YandexImages", "YandexImages", SEARCH),
    (r"YandexMetrika", "YandexMetrika", ADS),
    (r"YaDirectFetcher", "YaDirectFetcher", ADS),
    (r"YandexUserproxy", "YandexUserproxy", ADS),
    (r"YandexMarket", "YandexMarket", ADS),
    (r"YandexFavicons|YandexAdditionalBot_unused|YandexAdNet|YandexPartner|YandexVerticals|YandexTurbo"
     r"|YandexAccessibility|YandexSpravBot|YandexScreenshot|YandexMedia|YandexWebmaster|YandexForDomain"
     r"|YandexSitelinks|YandexCalendar|YandexDirectDyn", "Yandex: other robots", SEARCH),
    (r"AdsBot-Google", "AdsBot-Google", ADS),
    (r"Google-Read-Aloud", "Google-Read-Aloud", GOOGLE_SVC),
    (r"Google-Apps-Script", "Google-Apps-Script", SCRIPT),
    (r"Googlebot-Image", "Googlebot-Image", SEARCH),
    (r"Googlebot", "Googlebot", SEARCH),
    (r"Google-InspectionTool|GoogleOther|Google-Site-Verification|Storebot-Google|Mediapartners-Google"
     r"|APIs-Google|FeedFetcher-Google|Google-Extended|Google-PageRenderer", "Google: other robots", GOOGLE_SVC),
    (r"Chrome Privacy Preserving Prefetch Proxy", "Chrome Prefetch Proxy", GOOGLE_SVC),
    (r"bingbot|BingPreview|msnbot|adidxbot", "Bingbot", SEARCH),
    (r"Baiduspider", "Baiduspider", SEARCH),
    (r"Applebot", "Applebot", SEARCH),
    (r"PetalBot", "PetalBot", SEARCH),
    (r"SeznamBot", "SeznamBot", SEARCH),
    (r"DuckDuckBot", "DuckDuckBot", SEARCH),
    (r"Mail\.RU_Bot", "Mail.RU_Bot", SEARCH),
    (r"SaluteBot", "SaluteBot (Sber)", AI_TRAIN),
    (r"GPTBot", "GPTBot (OpenAI)", AI_TRAIN),
    (r"ChatGPT-User", "ChatGPT-User (OpenAI)", AI_USER),
    (r"OAI-SearchBot", "OAI-SearchBot (OpenAI)", AI_INDEX),
    (r"Claude-User", "Claude-User (Anthropic)", AI_USER),
    (r"Claude-SearchBot", "Claude-SearchBot (Anthropic)", AI_INDEX),
    (r"ClaudeBot|anthropic-ai", "ClaudeBot (Anthropic)", AI_TRAIN),
    (r"Perplexity-User", "Perplexity-User", AI_USER),
    (r"PerplexityBot", "PerplexityBot", AI_INDEX),
    (r"YandexAdditional", "YandexAdditional (Neuro)", AI_INDEX),
    (r"DuckAssistBot", "DuckAssistBot", AI_USER),
    (r"MistralAI-User", "MistralAI-User", AI_USER),
    (r"Amazonbot|Amzn-SearchBot", "Amazonbot", AI_TRAIN),
    (r"Bytespider", "Bytespider (ByteDance)", AI_TRAIN),
    (r"CyberOKInspect", "CyberOK (SKIPA)", "security scanner"),
    (r"archive\.org_bot|special_archiver", "Internet Archive", WEB_ARCHIVE),
    (r"CCBot", "CCBot (Common Crawl)", AI_TRAIN),
    (r"ExaSearchBot", "ExaSearchBot", AI_INDEX),
    (r"KeenableBot|Reflectionbot|Qwenbot", "AI: other indexers", AI_INDEX),
    (r"meta-externalagent|meta-webindexer|meta-externalfetcher", "Meta AI", AI_TRAIN),
    (r"GrokBot|cohere-ai|YouBot|Diffbot|ImagesiftBot|Timpibot|omgili|AI2Bot|Kangaroo Bot|PanguBot|DeepSeekBot",
     "AI: other", AI_TRAIN),
    (r"SemrushBot|SemrushBot-SA|SiteAuditBot", "SemrushBot", SEO),
    (r"AhrefsBot|AhrefsSiteAudit", "AhrefsBot", SEO),
    (r"MJ12bot", "MJ12bot (Majestic)", SEO),
    (r"DotBot", "DotBot (Moz)", SEO),
    (r"SERankingBacklinksBot|SERanking", "SE Ranking", SEO),
    (r"serpstatbot", "Serpstat", SEO),
    (r"PRLabBacklinkBot", "PRLab", SEO),
    (r"DataForSeoBot", "DataForSEO", SEO),
    (r"BLEXBot|Barkrowler|MegaIndex|keys-so|LinkpadBot|Linkdex|SEOkicks|Screaming Frog|SiteCheckerBot|Sitebulb"
     r"|netEstate|ZoominfoBot|Seekport|Mediatoolkit|BrightEdge|SEOlyt|serpstat|Spbot", "SEO: other", SEO),
    (r"vkShare|VK\b|vk\.com/dev", "vkShare", PREVIEW),
    (r"OdklBot", "OdklBot", PREVIEW),
    (r"facebookexternalhit|Facebot", "Facebook", PREVIEW),
    (r"TelegramBot", "TelegramBot", PREVIEW),
    (r"WhatsApp", "WhatsApp", PREVIEW),
    (r"Twitterbot", "Twitterbot", PREVIEW),
    (r"Pinterest", "Pinterest", PREVIEW),
    (r"Slackbot|Discordbot|SkypeUriPreview|Viber|LinkedInBot|redditbot|Iframely|Embedly|MicrosoftPreview",
     "Preview: other", PREVIEW),
    (r"Avitobot", "Avito Autoload", "feeds and marketplaces"),
    (r"Prufen", "Prufen", MONITOR),
    (r"DomainCheckService|UptimeRobot|Pingdom|StatusCake|Site24x7|uptime|monitor|Better Uptime|HetrixTools"
     r"|Uptime-Kuma|check_http|Zabbix", "Monitoring: other", MONITOR),
    (r"zgrab|CensysInspect|Palo Alto|Xpanse|ModatScanner|research-scan|ExchangeScanner|Nmap|nuclei|masscan"
     r"|l9explore|l9tcpid|InternetMeasurement|Expanse|Shodan|Netcraft|LeakIX|FlossoSecurityCheck|Odin|BitSightBot"
     r"|internet-scanner|httpx|fasthttp|WanScannerBot|Hello World|Nessus|sqlmap|Nikto|Acunetix|WPScan|scaninfo"
     r"|ivre-masscan|criminalip|abuse\.xmco|Go-http-client/2", "Security scanners", "vulnerability scanner"),
    (r"HeadlessChrome|Lightpanda|PhantomJS|Puppeteer|Playwright|Selenium|electron", "Headless browser", SCRIPT),
    (r"^curl/", "curl", SCRIPT),
    (r"python-requests|aiohttp|Python-urllib|python-httpx|Python/", "Python", SCRIPT),
    (r"Go-http-client", "Go-http-client", SCRIPT),
    (r"Java/|Apache-HttpClient|okhttp|Jakarta", "Java/okhttp", SCRIPT),
    (r"axios|node-fetch|undici|Node\.js", "Node.js", SCRIPT),
    (r"WordPress", "WordPress (pingback)", SCRIPT),
    (r"Wget|libwww|lwp-|PHP/|GuzzleHttp|Ruby|Faraday|Dart/|reqwest|HTTPie|Postman", "Scripts: other", SCRIPT),
    (r"br-crawler|jscrawler|rss-feed-miner|tphotobot|ImageMetaBot|^Mozilla/5\.0 \(compatible; crawler\)$"
     r"|crawler|spider|Crawler|Spider|bot\b|Bot\b|bot/|Bot/", "Other bots", OTHER_BOTS),
    (r"^-?$", "No User-Agent", SCRIPT),
]
HUMAN_APP = r"YandexSearch/|YaApp_|YaSearchBrowser|YaBrowser/"

# --- fixed values: user agent flags ------------------------------------------
UA_BROWSER = r"^Mozilla/5\.0 \("
UA_NOT_BROWSER = r"HeadlessChrome|PhantomJS|Lightpanda"
UA_OLD = r"MSIE [1-9]\.|Chrome/[1-5]\d\.|Firefox/[1-4]\d\.|Windows NT [45]\.|Android [1-4]\."
UA_MOBILE = r"Mobile|Android|iPhone|iPad"
UA_WEBVIEW = r"; wv\)|YaApp|FBAN|Instagram|VKAndroidApp|com\.vk|Telegram"
UA_WIN9X = r"Windows 95|Windows 98|Win 9x|Windows NT 4\.0"
UA_IOS = r"(?:iPhone|CPU) OS (\d+)_"
UA_GECKO_DATE = r"Gecko/(20\d{2})\d{4}\b"
UA_IOS_MIN = 7

# --- fixed values: monitoring services, (name, pattern), first match wins -----
MONITOR_SERVICES = [
    ("BitrixCloud Monitoring", r"BitrixCloud Monitoring"), ("Prufen", r"Prufen"), ("Overseer", r"Overseer"),
    ("DomainCheckService", r"DomainCheckService"), ("UptimeRobot", r"UptimeRobot"), ("Pingdom", r"Pingdom"),
    ("StatusCake", r"StatusCake"), ("Site24x7", r"Site24x7"),
    ("Better Stack", r"Better ?Uptime|BetterStack|Better Stack"), ("HetrixTools", r"HetrixTools"),
    ("Uptime Kuma", r"Uptime-?Kuma"), ("Zabbix", r"Zabbix"), ("Nagios", r"check_http|Nagios"),
    ("Datadog Synthetics", r"Datadog.*Synthetic"), ("Freshping", r"Freshping"),
    ("Host-tracker", r"host-tracker|HostTracker"),
    ("Yandex.Metrica: monitoring", r"YandexMetrika.*monitor|Yandex.*Monitor"),
    ("Ping-Admin", r"Ping-?Admin"), ("Monitorus", r"Monitorus"),
]
MONITOR_MAX_ADDRESSES = 3

# --- fixed values: referrer host groups --------------------------------------
REF_SEARCH = (r"(^|\.)(yandex\.[a-z.]+|ya\.ru|google\.[a-z.]+|bing\.com|go\.mail\.ru|duckduckgo\.com"
              r"|search\.yahoo\.com|rambler\.ru|nova\.rambler\.ru)$")
REF_AI = (r"(^|\.)(chatgpt\.com|chat\.openai\.com|perplexity\.ai|copilot\.microsoft\.com|gemini\.google\.com"
          r"|chat\.deepseek\.com|giga\.chat|claude\.ai|alice\.yandex\.ru|chat\.mistral\.ai|you\.com|grok\.com)$")
REF_SOCIAL = (r"(^|\.)(vk\.com|vk\.ru|ok\.ru|t\.me|telegram\.org|web\.telegram\.org|facebook\.com|instagram\.com"
              r"|l\.instagram\.com|dzen\.ru|youtube\.com|whatsapp\.com|max\.ru|web\.max\.ru|pinterest\.com"
              r"|tiktok\.com|x\.com|twitter\.com|away\.vk\.com|m\.vk\.com)$")
REF_MAPS = r"(^|\.)(2gis\.[a-z]+|maps\.google\.[a-z.]+|yandex\.ru/maps)$"
REF_AGGREGATOR = (r"(^|\.)(cian\.ru|avito\.ru|domclick\.ru|realty\.ya\.ru|realty\.yandex\.ru|market\.yandex\.ru"
                  r"|novostroy-m\.ru|novostroev\.ru|nedvex\.ru|yell\.ru|zoon\.ru|flamp\.ru|otzovik\.com)$")

# --- fixed values: channel labels ---------------------------------------------
CH_ADS, CH_AI, CH_MAIL, CH_INTERNAL = "ads", "ai assistants", "mailings", "internal"
CH_MAPS, CH_SEARCH, CH_SOCIAL = "maps", "search", "social"
CH_AGGREGATOR, CH_LABELS, CH_DIRECT, CH_LINKS = "aggregators", "other labels", "direct", "links"
# what decides a channel: (channel, what is behind it, where to look, pattern); {host}, {engine} and {label} are read from the entry request
CHANNEL_RULES = [
    (CH_ADS, "Yandex Direct", "query", r"yclid=|utm_source=(yandex|yd|ya|direct)"),
    (CH_ADS, "Google Ads", "query", r"gclid=|gbraid=|wbraid=|utm_source=google.*cpc|cpc.*utm_source=google"),
    (CH_ADS, "VK Ads", "query", r"rb_clickid=|vkclid=|utm_source=(vk|mytarget|vkads)"),
    (CH_ADS, "Telegram Ads", "query", r"utm_source=(tg|telegram).*cpc|cpc.*utm_source=(tg|telegram)"),
    (CH_AI, "ChatGPT", "query", r"utm_source=chatgpt\.com"),
    (CH_MAIL, "", "query", r"utm_medium=(e-?mail|newsletter|rassylka)"),
    (CH_ADS, "other systems", "query", r"utm_medium=(cpc|cpm|cpa|paid|ppc)"),
    (CH_INTERNAL, "", "internal", r"yes"),
    (CH_AI, "{host}", "host", REF_AI),
    (CH_MAPS, "{host}", "host", REF_MAPS),
    (CH_MAPS, "{host}", "host and referrer", r"^\S*(yandex|google)\.\S* .*/maps"),
    (CH_SEARCH, "{engine}", "host", REF_SEARCH),
    (CH_SOCIAL, "{host}", "host", REF_SOCIAL),
    (CH_AGGREGATOR, "{host}", "host", REF_AGGREGATOR),
    (CH_LABELS, "{label}", "query", r"utm_"),
    (CH_DIRECT, "", "host", r"^$"),
    (CH_LINKS, "{host}", "host", r""),
]

# --- fixed values: visit groups -----------------------------------------------
PEOPLE, ROBOTS, BOTS, MONITORS, UTILITIES = "people", "robots", "bots", "monitors", "utilities"
OWN, EXTERNAL_SITES, SUSPECTS = "own", "external_sites", "suspects"
GROUPS = [PEOPLE, ROBOTS, MONITORS, UTILITIES, BOTS, OWN]

# --- fixed values: networks -----------------------------------------------------
HOSTING_ORG = (
    r"(?i)host|cloud|server|data ?cent|datacamp|ovh|digitalocean|amazon|microsoft|alibaba|tencent|timeweb|selectel"
    r"|contabo|hetzner|leaseweb|m247|constant company|linode|akamai|fdcservers|delska|clouvider|limestone"
    r"|purevoltage|3xk|techoff|unmanaged|aeza|beget|reg\.ru|firstbyte|vdsina|serverius|vultr|oracle|ionos|scaleway"
    r"|netcup|kamatera|zenlayer|psychz|quadranet|colocrossing|choopa|g-core|gcore|stark industries|pq hosting"
    r"|ishosting|justhost|sprinthost|mchost|masterhost|ruvds|smart ape|web2objects|hostkey|servers|vps|dedicated"
    r"|colo|webzilla|ucloud|huawei|baidu|worldstream|nforce|hivelocity|equinix|xhost|cdn77|datapacket|melbicom"
    r"|yandex\.cloud|cloud llc")
RELAY_ASN = [13335, 714]
MOBILE_ASN = [8359, 3216, 16345, 31133, 25159, 12958, 20771, 29648, 31163, 31195, 31205, 31208, 31213, 31224,
              35298, 12714, 15378, 25513, 48092, 2118, 12389]
BANK_ORG = r"(?i)sber|tbank|tinkoff|vtb|alfa-bank|gazprombank|raiffeisen"
CLOUD_ASN = [15169, 396982, 8075, 16509, 14618]
YANDEX_ASN = 13238
NET_UNKNOWN, NET_RELAY, NET_MOBILE, NET_BANK = "unknown", "vpn/proxy relay", "mobile operator", "bank/corporation"
NET_YANDEX, NET_DC, NET_RU, NET_FOREIGN = "Yandex", "data center", "RU access provider", "foreign access provider"

# --- fixed values: networks allowed for declared robots, (family, ASNs) ---------
FAMILY_ASNS = [
    ("YandexBot", [13238]), ("YandexRenderResourcesBot", [13238]), ("YandexImages", [13238]),
    ("YandexMetrika", [13238]), ("YaDirectFetcher", [13238]), ("YandexMarket", [13238]),
    ("Yandex: other robots", [13238]), ("YandexAdditional (Neuro)", [13238]),
    ("Googlebot", [15169]), ("Googlebot-Image", [15169]), ("AdsBot-Google", [15169]),
    ("Google: other robots", [15169, 396982]), ("Bingbot", [8075]), ("Applebot", [714, 6185]),
    ("GPTBot (OpenAI)", [8075]), ("OAI-SearchBot (OpenAI)", [8075]), ("ChatGPT-User (OpenAI)", [8075]),
    ("TelegramBot", [62041, 59930, 44907, 211157]), ("Internet Archive", [7941]),
]
SEARCH_FAMILIES = ["YandexBot", "Googlebot", "YandexRenderResourcesBot", "Googlebot-Image", "Bingbot"]

# --- fixed values: probes, (id, target, strength, pattern), case-insensitive -----
PROBES = [
    ("secrets", "config leaks", "strong",
     r"(^|/)\.(gitconfig|htaccess|gitignore|gitattributes|gitmodules|gitlab-ci\.ya?ml|travis\.ya?ml|user\.ini"
     r"|bash_history|mysql_history|env|git|aws|ssh|svn|hg|htpasswd|git-credentials|boto|s3cfg|docker|npmrc|pypirc"
     r"|netrc|vscode|idea|DS_Store)(\b|/|$)|/wp-config\.php|/docker-compose\.ya?ml$|/config\.(json|ya?ml|env|php\.bak)$"
     r"|/credentials(\.json)?$|/aws-credentials|/secrets?\.(json|ya?ml)$|/(sendgrid|mailgun)\.env$|/\.?env\.(json|js)$"
     r"|/\.settings(_extra)?\.php$|/php_interface/dbconn\.php$|\.(tfstate|tfvars)(\.|$)|/\.terraform/"),
    ("dumps", "backups and dumps", "strong",
     r"\.(sql|sqlite|sqlitedb|db|dump)(\.(gz|bz2|xz|lz|lzma|zst|z|zip|tar|7z))*$"
     r"|/(backup|backups|dump|database|db|site|www|html|public_html|archive|bitrix|local|auth|panel|modules|tools"
     r"|services)\.(tar|tgz|tar\.gz|zip|rar|7z|bz2|xz|lz|z)$"),
    ("debug", "debug and frameworks", "strong",
     r"phpinfo|php-?info\.php|/info\.php$|/php\.php$|/vendor/phpunit|eval-stdin|/actuator(/|$)|/server-status"
     r"|/_profiler|/telescope|/_ignition|/@fs/|/__vite|/\.vite/"),
    ("db_panels", "database panels", "strong", r"/phpmyadmin|/pma/|/adminer|/myadmin|/sqladmin|/dbadmin"),
    ("iot", "routers, IoT, mail", "strong",
     r"/boaform|/HNAP1|/cgi-bin/|/GponForm|/setup\.cgi|/owa/|/autodiscover/|/ecp/"),
    ("wordpress", "WordPress", "strong",
     r"/wp-login\.php|/wp-admin|/xmlrpc\.php|/wp-content/(plugins|themes)/|/wp-includes/|/wp-json/"
     r"|/wp-sitemap[\w.-]*\.xml(\.gz)?$"),
    ("obfuscation", "filter evasion", "strong", r"%(3[0-9]|4[1-9a-f]|5[0-9a]|6[1-9a-f]|7[0-9a])"),
    ("installers", "installers", "weak",
     r"/restore\.php|/bitrixsetup\.php|/install\.php|/setup\.php|/installer\.php"),
    ("backup_dirs", "backups and archives", "weak",
     r"/backup|\.(bak|old|swp|orig|save)$|\.(tar|tgz|zip|rar|7z|bz2|xz|lz|lzma|zst|gz|z)$"),
    ("admin_guess", "admin panels", "weak", r"^/(admin|administrator|manager|panel|cpanel|webadmin|backend|cp)(/|$)"),
    ("debug_words", "debug and frameworks", "weak", r"/debug|/console|/test\.php$|/shell"),
    ("contacts_guess", "contact harvesting", "weak",
     r"^/(contacts?|contato|contacto|contactos|contatti|kontakt|kontakte|kontakty?|kapcsolat|iletisim|lien-he|lienhe"
     r"|yhteystiedot|联系我们|联系|連絡先|お問い合わせ|문의|연락처|контакты|связаться|о-нас|о-компании|contact-us"
     r"|kontakty|kontaktyi|kontakti|o-nas|o-kompanii|about|about-us|company|team|rekvizity|requisites"
     r"|advertis(e|ing)|for-advertisers|ad-info|adv|reklama|media-?kit|sotrudnichestvo|partners|impressum|feedback"
     r"|obratnaya-svyaz|privacy(-policy)?|politika)/?$"),
    ("login_guess", "login guessing", "weak",
     r"^/(login|my-account|account|cart|checkout|basket|wishlist|signin|sign-in|logon|auth|user/login|users/sign_in"
     r"|account/login|admin/login|login\.(action|rsp|jsp|asp|aspx|do|cgi|html?))/?$"),
]
# general scanner addresses on top of the probe dictionary; the second pattern must not match
VULNERABILITY = (
    r"^/\.env|/\.git/|/\.aws|/\.ssh|/\.svn|/\.DS_Store|phpinfo|/wp-login\.php|/wp-admin|/xmlrpc\.php"
    r"|/wp-content/plugins|/phpmyadmin|/pma/|/adminer|/vendor/phpunit|/actuator|/cgi-bin/|/server-status"
    r"|/config\.(json|yml|yaml|php)|/backup|\.(sql|bak|old|swp|tar|tar\.gz|tgz|zip|rar)$|/shell|/eval-stdin|/boaform"
    r"|/HNAP1|/owa/|/autodiscover|/restore\.php|/bitrixsetup\.php|/install\.php|/setup\.php|/telescope"
    r"|/_profiler|/debug|/console")
WELL_KNOWN_ANY, WELL_KNOWN_ACME = r"/\.well-known/", r"/\.well-known/acme"
# scanner signatures: minimum counts
PROBE_SERIES_MIN, VARIANTS_MIN, FAN_404_MIN, FAN_404_IP_MIN, STRONG_PROBES_SCANNER = 3, 3, 5, 5, 10

# --- fixed values: weights of "a human stands behind it" -------------------------
HUMAN_WEIGHTS = {"loads_resources": 2, "live_tempo": 2, "home_network": 1, "browser": 1, "walks_site": 1}
HUMAN_SCORE_MIN, HUMAN_MAX_PROBES, HUMAN_REGULAR_DAYS = 5, 10, 2
HUMAN_RESOURCES_MIN, HUMAN_TEMPO_RPS, HUMAN_PROBE_GAP_MIN = 3, 1.0, 3
SHARED_LIST_IPS, SHARED_LIST_SHARE, MAX_BROWSERS_PER_IP = 3, 0.5, 3

# --- fixed values: site engines, (engine, address pattern) ------------------------
ENGINES = [
    ("1C-Bitrix", r"^/bitrix/|^/local/(templates|components|js)/|^/upload/iblock/"),
    ("WordPress", r"^/wp-content/|^/wp-includes/|^/wp-json/"),
    ("Joomla", r"^/components/com_|^/media/jui/|^/media/system/"),
    ("UMI.CMS", r"^/images/cms/|^/udata/|^/emarket/"),
    ("Drupal", r"^/sites/default/files/|^/core/misc/|^/misc/drupal\.js"),
    ("MODX", r"^/assets/components/|^/connectors/"),
    ("OpenCart", r"^/catalog/view/theme/"),
    ("Webasyst/Shop-Script", r"^/wa-data/|^/wa-apps/|^/wa-content/"),
    ("NetCat", r"^/netcat/|^/netcat_files/"),
    ("HostCMS", r"^/hostcmsfiles/"),
    ("DLE", r"^/engine/classes/|^/templates/.+/js/libs\.js"),
    ("Tilda", r"^/tild[\w-]*\.(js|css)|tildacdn"),
    ("Next.js", r"^/_next/"),
    ("Nuxt", r"^/_nuxt/"),
    ("Django", r"^/static/admin/"),
    ("Laravel", r"^/livewire/|^/vendor/livewire/"),
]
ADMIN_PATHS = {
    "1C-Bitrix": r"^/bitrix/admin/", "WordPress": r"^/wp-admin/|^/wp-login\.php", "Joomla": r"^/administrator/",
    "UMI.CMS": r"^/admin/", "Drupal": r"^/user/login|^/admin/", "MODX": r"^/manager/", "OpenCart": r"^/admin/",
    "Webasyst/Shop-Script": r"^/webasyst/", "NetCat": r"^/netcat/admin/", "HostCMS": r"^/admin/",
    "DLE": r"^/admin\.php", "Django": r"^/admin/", "Laravel": r"^/admin/",
}
GENERIC_ADMIN = r"^/admin/|^/administrator/|^/manager/|^/panel/|^/cp/|^/backend/"
AD_PARAMS = ("yclid gclid gbraid wbraid fbclid rb_clickid _openstat utm_source utm_medium utm_campaign utm_content "
             "utm_term calltouch_tm roistat from ysclid erid vkclid msclkid").split()
SUCCESS_MARK = r"(?i)success|thank|spasibo|thanks|ok=|sent|otpravleno"

# --- fixed values: files of visits without pages -------------------------------------
PAGE_ASSETS = "css js mjs map woff woff2 ttf otf eot".split()
ASSET_KINDS = {
    "styles": ["css"], "scripts": ["js", "mjs"], "fonts": ["woff", "woff2", "ttf", "otf", "eot"],
    "images": ["jpg", "jpeg", "png", "gif", "webp", "svg", "avif", "ico", "bmp"],
}
# what visits of files only take: downloads by kind, data only in folders of exports
DOWNLOADS = [
    ("documents", "pdf doc docx odt rtf xls xlsx ods ppt pptx csv txt"), ("archives", "zip rar 7z tar.gz"),
    ("drawings", "dwg dxf step stp stl obj skp 3ds psd tif tiff"), ("programs", "exe msi dmg apk iso bin"),
    ("books", "epub fb2 mobi djvu"), ("contacts", "ics vcf"),
]
DATA_EXTENSIONS = "json xml yml"
DATA_FOLDERS = "/upload/ /export/ /exports/ /download/ /downloads/ /files/ /price/ /prices/".split()
NOT_DATA_FOLDERS = "/api/ /ajax/ /bitrix/ /wp-json/ /.well-known/".split()
SOUND_AND_VIDEO, PHOTOS, CONTENT_IMAGES = "mp3 wav mp4 mov webm", "jpg jpeg png webp heic", "jpg jpeg png webp gif avif"
DECORATION = "logo|icon|sprite|favicon"
FILES_NEIGHBOURS_MINUTES, FILES_LIST_MIN, FILES_LIST_SHARE, FILES_REPEAT_MIN, FILES_404_MIN, FILES_ALMOST_ALL = 30, 10, 0.8, 3, 5, 0.8
FILES_OFFICE_BROWSERS, FILES_OFFICE_HOURS, FILES_PHOTO_FACTOR, FILES_ONE_PAGE_KINDS, FILES_ONE_PAGE_SECONDS = 3, (9, 19), 5, 2, 60
FILES_SAME_IPS_MIN, FILES_SAME_SHARE, FILES_BURST_HOURS, FILES_BURST_SHARE = 20, 0.8, 6, 0.5
SERVICE_FILES = r"^/(robots\.txt|sitemap[^/]*|favicon[^/]*|apple-touch-icon[^/]*)$"
SENSITIVE = [
    r"/backups?(/|$|[._-])", r"\.(sql|dump)(\.(gz|zip|bz2|7z))?$", r"\.(bak|wpress|jpa)$",
    r"^/[^/]+\.(zip|rar|7z|tar|tar\.gz|tgz|gz)(\.\d+)?$",
    r"/(db|old|sql|dumps?|backups?|archives?)/[^/]*\.(zip|rar|7z|tar|tar\.gz|tgz|gz|bz2|sql|bak|dump)(\.\d+)?$",
    r"/restore\.php$", r"/\.env",
]
TRANSFER = [r"/restore\.php$", r"\.(tar\.gz|tgz|tar|zip)\.\d+$"]
BACKUP_SEARCH_MIN_PATHS, BACKUP_MANY_IPS = 2, 3
SELF_CHECK = r"^/bitrix/admin/site_checker\.php$|^/bitrix/site_check_exec\.php$|^/bitrix/tools/check_|^/wp-cron\.php$"

# --- fixed values: address forms -------------------------------------------------------
PAGE_EXTENSIONS = "php php3 php4 php5 php7 php8 phtml html htm shtml xhtml asp aspx jsp jspx cfm cgi pl do action".split()
TLD_TAILS = ("ru com net org su info io by kz ua uz biz pro online site store shop me tv club рф de eu uk us co app dev").split()
FILE_GROUPS_BY_EXTENSION = [
    ("images", "jpg jpeg jpe jfif png apng webp gif svg svgz avif bmp tif tiff ico cur heic heif"),
    ("video and sound", "mp4 m4v webm mov avi mkv wmv flv mpg mpeg 3gp ogv mp3 ogg oga wav m4a aac flac opus m3u8 ts"),
    ("fonts", "woff woff2 ttf otf eot"),
    ("styles and scripts", "css js mjs cjs jsx tsx wasm"),
    ("source maps", "map"),
    ("documents", "pdf doc docx xls xlsx xlsm ppt pptx rtf odt ods odp txt md epub djvu fb2 mobi csv tsv"),
    ("archives", "zip rar 7z gz tgz tar bz2 xz lz lzma zst z cab iso"),
    ("widget data", "xml json jsonld geojson yml yaml ics vcf kml kmz gpx"),
    ("3d and graphics", "glb gltf obj fbx usdz stl psd ai eps cdr dwg dxf sketch fig"),
    ("programs", "exe msi dmg pkg apk aab ipa deb rpm appimage jar war bin run"),
    ("databases and dumps", "sql sqlite sqlite3 sqlitedb db mdb accdb dump bak old orig swp save backup"),
    ("configs", "env ini conf config cfg toml properties htaccess htpasswd py rb sh bash ps1 bat java c cpp go rs sln lock "
                "log pem key crt p12 pfx tfstate tfvars hcl"),
    ("other files", "swf torrent dat xsl xslt"),
]
WELL_KNOWN_STANDARD = (
    r"^/\.well-known/(security\.txt|assetlinks\.json|apple-app-site-association|change-password|traffic-advice"
    r"|passkey-endpoints|openid-configuration|oauth-authorization-server|oauth-protected-resource|jwks\.json|webfinger"
    r"|host-meta(\.json)?|nodeinfo|dnt-policy\.txt|gpc\.json|ai-plugin\.json|mcp\.json|agent\.json|openai-plugin\.json"
    r"|matrix/.*|caldav|carddav|mta-sts\.txt|pki-validation/.*|apple-developer-merchantid-domain-association"
    r"|keybase\.txt|nostr\.json|did\.json|ucp|privacy-sandbox-attestations\.json|related-website-set\.json|tdmrep\.json"
    r"|api-catalog|resourcesync|timezone|stun-key|credentials\.json)$")
FILE_GROUPS_BY_ADDRESS = [
    ("for robots", r"^/(robots\.txt|[\w-]*sitemap[\w.-]*\.xml(\.gz)?|sitemap/.*|llms(-full)?\.txt|ai\.txt|ads\.txt"
                   r"|app-ads\.txt|humans\.txt|security\.txt)$"),
    ("ownership proofs", r"(^/yandex_[0-9a-f]+\.html$|^/google[0-9a-f]+\.html$|^/\.well-known/acme-challenge/"
                         r"|^/BingSiteAuth\.xml$|^/mailru-domain[\w-]*\.html$)"),
    ("service (.well-known)", WELL_KNOWN_STANDARD),
    ("feeds and exports", r"(/export/|/feeds?(/|\.xml$|$)|/rss(/|\.xml$|$)|yandex[\w-]*\.xml$|google[\w-]*\.xml$)"),
    ("icons and manifest", r"(favicon[\w.-]*\.(ico|png|svg)$|apple-touch[\w.-]*\.png$|/manifest\.json$|\.webmanifest$"
                           r"|/browserconfig\.xml$)"),
]
HIDDEN_FILES = ("htaccess htpasswd gitignore gitattributes gitmodules gitlab-ci.yml travis.yml env env.local "
                "env.production env.example user.ini npmrc yarnrc dockerignore editorconfig eslintrc prettierrc babelrc "
                "browserslistrc settings.php settings_extra.php ds_store bash_history mysql_history git-credentials svn hg").split()
CONSTRUCT = (r"(?i)\$\{|\{\{|%7B%7B|%24%7B|'\s*\+|\+\s*'|%27(%20|\s)*\+|\+(%20|\s)*%27|[\"<>]|%22|%3C|%3E|//|&|\\")
OPTIONAL_FILES = [
    r"^/llms(-full)?\.txt$", r"^/ai\.txt$", r"^/ads\.txt$", r"^/app-ads\.txt$", r"^/humans\.txt$", r"^/security\.txt$",
    r"^/\.well-known/security\.txt$", r"^/\.well-known/traffic-advice$", r"^/\.well-known/passkey-endpoints$",
    r"^/\.well-known/change-password$", r"^/apple-touch-icon[\w.-]*\.png$", r"^/browserconfig\.xml$", r"^/manifest\.json$",
    r"^/site\.webmanifest$",
]
AI_FILES = [r"^/llms(-full)?\.txt$", r"^/ai\.txt$"]
SERVICE_ADDRESSES = r"(?i)^/robots\.txt$|sitemap[\w-]*\.xml|\.yml$|/export/|feed|\.xml$"
INVISIBLE_FILES = r"(?i)placeholder|lazy|blank|spacer"

# --- fixed values: error-log message types, first match wins ------------------------------
ERROR_TYPES = [
    ("backend: timeout", r"upstream timed out"),
    ("backend: no answer", r"connect\(\) failed|no live upstreams|recv\(\) failed|prematurely closed"),
    ("database", r"Too many connections|MySQL server has gone away|Lost connection|Can.t connect to|SQLSTATE|DB query error"
                 r"|Deadlock|marked as crashed|mysqli|Connection refused.*3306"),
    ("PHP Fatal", r"PHP Fatal|PHP Parse error"), ("PHP Warning", r"PHP Warning"),
    ("PHP Notice/Deprecated", r"PHP (Notice|Deprecated)"),
    ("request too large (413)", r"client intended to send too large body"),
    ("rate limit", r"limiting (requests|connections)"), ("forbidden by rule", r"access forbidden by rule"),
    ("file not found", r"No such file|is not found|open\(\).*failed \(2"), ("permissions", r"Permission denied|\(13:"),
    ("disk full", r"No space left"), ("too few connections", r"worker_connections"), ("SSL", r"SSL_|ssl"),
    ("response buffered (normal)", r"buffered to a temporary file"), ("other", r"."),
]
AD_MARK = r"(?:^|&)(?:yclid|gclid|fbclid|utm_source|utm_medium|utm_campaign|_openstat)="
TIMEOUT_MESSAGE = (r"(?i)timed out|upstream prematurely closed|no live upstreams|Connection reset by peer"
                   r"|Resource temporarily unavailable")

# --- fixed values: attacks in addresses, scanner targets -----------------------------------
ATTACK = (r"(?i)(union(\s|%20|\+)+select|'(\s|%20|\+)*or(\s|%20|\+)*'?1'?=|sleep\(|benchmark\(|<script|%3Cscript"
          r"|javascript:|\.\./|%2e%2e%2f|\$\{jndi:|/etc/passwd|cmd=|exec\(|base64_decode|wget(\s|%20)http|curl(\s|%20)http)")
SCAN_TARGETS = [
    ("WordPress", r"(?i)wp-|xmlrpc"), ("config leaks", r"(?i)\.env|\.git|\.aws|\.ssh|\.svn|config\.|credentials"),
    ("backups and dumps", r"(?i)backup|\.(sql|sqlite|sqlitedb|db|dump|bak|old|tar|tgz|zip|rar|bz2|xz|lz)(\.|$)"),
    ("database panels and admin", r"(?i)phpmyadmin|pma|adminer|/admin"),
    ("debug and frameworks", r"(?i)phpinfo|actuator|telescope|_profiler|debug|console|phpunit"),
    ("installers", r"(?i)restore\.php|bitrixsetup|install\.php|setup\.php"),
    ("routers, IoT, mail", r"(?i)boaform|HNAP|owa|autodiscover|cgi-bin"), ("other", r"(?i)."),
]
