"""Names, codes and patterns that decide results and must not drift."""

# Browser name and version pattern, first match wins.
BROWSERS = [
    ("Edge", r"(?i)Edg/(\d+\.\d+)"),
    ("Chrome", r"(?i)Chrome/(\d+\.\d+)"),
    ("Safari", r"(?i)Version/(\d+\.\d+).*Safari"),
    ("Firefox", r"(?i)Firefox/(\d+\.\d+)"),
    ("Opera", r"(?i)(?:Opera|OPR)/(\d+\.\d+)"),
    ("IE", r"(?i)MSIE\s+(\d+\.\d+)"),
    ("IE", r"(?i)Trident/.*rv:(\d+\.\d+)"),
]

# Operating system name and version pattern, first match wins; the last two carry no version.
SYSTEMS = [
    ("Windows", r"(?i)Windows NT (\d+\.\d+)"),
    ("macOS", r"(?i)Mac OS X (\d+[._]\d+)"),
    ("iOS", r"(?i)(?:iPhone|iPad).*OS (\d+[._]\d+)"),
    ("Android", r"(?i)Android (\d+\.\d+)"),
    ("Linux", r"(?i)Linux()"),
    ("ChromeOS", r"(?i)CrOS()"),
]

BOT_PATTERN = r"(?i)bot|crawler|spider|scraper|curl|wget|python|go-http"
MOBILE_PATTERN = r"(?i)mobile|android|iphone|ipad|ipod|blackberry|windows phone"

# Bot substring (lower case) and display name, tried in this order.
BOTS = [
    ("googlebot", "Googlebot"),
    ("bingbot", "Bingbot"),
    ("slurp", "Yahoo Slurp"),
    ("duckduckbot", "DuckDuckBot"),
    ("baiduspider", "Baidu Spider"),
    ("yandexbot", "YandexBot"),
    ("facebookbot", "Facebookbot"),
    ("twitterbot", "Twitterbot"),
    ("linkedinbot", "LinkedInBot"),
    ("applebot", "Applebot"),
    ("python", "Python Client"),
    ("go-http", "Go HTTP Client"),
    ("curl", "cURL"),
    ("wget", "Wget"),
    ("postman", "Postman"),
]

# Windows NT kernel version and product name.
WINDOWS_RELEASES = {
    "10.0": "Windows 10/11",
    "6.3": "Windows 8.1",
    "6.2": "Windows 8",
    "6.1": "Windows 7",
    "6.0": "Windows Vista",
    "5.1": "Windows XP",
}

# TLS protocol numbers.
TLS_VERSIONS = {769: "1.0", 770: "1.1", 771: "1.2", 772: "1.3"}

# TLS cipher suite numbers.
TLS_CIPHERS = {
    4865: "TLS_AES_128_GCM_SHA256",
    4866: "TLS_AES_256_GCM_SHA384",
    4867: "TLS_CHACHA20_POLY1305_SHA256",
    49195: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256",
    49196: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    49199: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256",
    49200: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    52392: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256",
    52393: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256",
}

# Common Log Format: client, user, time, method, target, status, size, referer, agent.
CLF_PATTERN = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([A-Z]+) ([^ "]+)? HTTP/[0-9.]+" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'
# The proxy's extension adds: request number, backend name, backend URL, milliseconds.
CLF_PROXY_TAIL = r' (\d+) "([^"]*)" "([^"]*)" (\d+)ms'
CLF_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"

# JSON keys that mark a flat proxy line: one of each group must be present.
FLAT_JSON_TIME_KEYS = ("time", "StartUTC")
FLAT_JSON_CLIENT_KEYS = ("request_X-Real-Ip", "ClientHost", "ClientAddr")
# A file counts as flat proxy JSON when its first line has two of these keys.
FLAT_JSON_FILE_KEYS = ("ClientHost", "RequestMethod", "RequestPath", "DownstreamStatus", "RouterName")
# Logger name prefix of nested access-log lines.
NESTED_JSON_LOGGER = "http.log.access"

REQUEST_SCHEMES = ("http", "https", "ws", "wss", "")
WORLD_COUNTRIES = 195
