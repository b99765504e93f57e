"""Fixed values. They must equal the published behaviour, so they are stated plainly here."""

# Classes: (id, name, display name, priority, display priority, severity tier)
CLASSES = [
    (0, "None", "Discovery", 0, 0, "good"),
    (1, "Bogon", "Bogon/Martian", 70, 0, "crit"),
    (2, "Hijack", "BGP Hijack", 100, 3, "crit"),
    (3, "RouteLeak", "Route Leak", 80, 3, "crit"),
    (4, "Outage", "Outage", 90, 3, "crit"),
    (5, "DDoSMitigation", "DDoS Mitigation", 50, 1, "poly"),
    (6, "Flap", "Flap", 40, 2, "bad"),
    (8, "PathHunting", "Path Hunting", 30, 1, "poly"),
    (9, "Discovery", "Discovery", 20, 0, "good"),
    (10, "MinorRouteLeak", "Route Leak", 60, 3, None),
]
NONE, BOGON, HIJACK, ROUTE_LEAK, OUTAGE = 0, 1, 2, 3, 4
DDOS, FLAP, PATH_HUNTING, DISCOVERY, MINOR_LEAK = 5, 6, 8, 9, 10
PRIORITY = {c[0]: c[3] for c in CLASSES}

# Names the web report uses for a class.
WEB_NAMES = {
    2: "Hijack", 3: "Route Leak", 10: "Minor Route Leak", 4: "Outage",
    5: "DDoS Mitigation", 6: "Flap", 8: "Path Hunting", 9: "Discovery",
}

# Classes that open an incident and feed the alert windows.
CRITICAL = [HIJACK, ROUTE_LEAK, MINOR_LEAK, OUTAGE]

# Classes a summary lists, and the ones the display shows.
SUMMARY_CLASSES = [1, 2, 3, 4, 5, 6, 8, 9]
DISPLAY_CLASSES = [2, 3, 4, 6, 8, 5, 9]

# Seconds until a class expires; the rest take EXPIRY_DEFAULT.
EXPIRY = {OUTAGE: 1800, FLAP: 60}
EXPIRY_DEFAULT = 600

BUCKET_SECONDS = 600        # look-back of the per-prefix counters
SESSION_RETENTION = 3600    # a withdrawn session is forgotten after this
OUTAGE_DELAY = 10           # a prefix must be fully withdrawn this long

# Leak types: (code, label)
LEAK_TYPES = [
    (0, "Unknown"),
    (1, "Prefix Re-Origination"),
    (2, "Hairpin Turn"),
    (3, "Lateral Infection"),
    (4, "Flowspec"),
    (5, "RTBH"),
    (6, "Traffic Redirection"),
    (7, "Valley-Free Violation"),
]
LEAK_HAIRPIN, LEAK_LATERAL, LEAK_VALLEY_FREE = 2, 3, 7

TIER1_ASNS = [174, 209, 701, 1239, 1299, 2828, 2914, 3257, 3320, 3356, 3549, 3561, 5511,
              6453, 6461, 6762, 7018, 12956]
LARGE_ASNS = [15169, 16509, 8075, 13335, 20940, 14618, 32934, 16276]

# Brand words: two AS names holding the same one count as siblings.
BRAND_WORDS = ["china telecom", "chinanet", "google", "cloudflare", "amazon", "akamai"]

EXCLUDED_ASNS = [
    (749, "DoD Honeypot"), (8003, "DoD Honeypot"),
    (12654, "BGP Research"), (6447, "BGP Research"),
    (398324, "Security Scanner"), (398722, "Security Scanner"), (398705, "Security Scanner"),
    (22168, "Security Scanner"), (10439, "Security Scanner"),
]

BEACON_PREFIXES = [
    "84.205.65.0/24", "84.205.81.0/24", "84.205.67.0/24", "84.205.64.0/24", "84.205.80.0/24",
    "84.205.69.0/24", "84.205.85.0/24", "84.205.70.0/24", "84.205.86.0/24", "84.205.75.0/24",
    "84.205.91.0/24", "84.205.82.0/24", "84.205.83.0/24", "84.205.76.0/24", "84.205.92.0/24",
    "84.205.88.0/24", "93.175.153.0/24", "93.175.152.0/24", "93.175.154.0/25",
    "93.175.154.128/28", "84.205.66.0/24", "93.175.146.0/24", "93.175.147.0/24",
]

# Networks whose network address marks a bogon when no bogon list is loaded: loopback, multicast,
# private, link-local, shared and documentation space, then unspecified (exact address only).
MARTIAN_NETWORKS = [
    "127.0.0.0/8", "224.0.0.0/4", "0.0.0.0/32", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16",
    "169.254.0.0/16", "100.64.0.0/10", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24",
    "::1/128", "ff00::/8", "::/128", "fe80::/10",
]

# Alert rules: (type, name, least IPv4 addresses, least IPv6 prefixes, percentage must exceed)
ALERT_RULES = [
    (1, "loc", 5000, 500, 10.0),
    (2, "asn", 5000, 500, 0.0),
    (3, "country", 50000, 500, 10.0),
    (4, "org", 20000, 500, 0.0),
]
ALERT_WINDOW, ALERT_RECENT, ALERT_MIN_SCORE, ALERT_COOLDOWN = 300, 60, 2.0, 300
ALERT_KEY_SECONDS = 14400
EWMA_ALPHA, EWMA_MAX_GAP, EWMA_RETENTION, EWMA_MIN_SD = 0.95, 60, 3600, 1e-5
SIGNIFICANT_IPV4, SIGNIFICANT_IPV6 = 5000, 500
DAY = 86400

# Latitudes beyond this are drawn at it.
MAP_LATITUDE = 89.5
