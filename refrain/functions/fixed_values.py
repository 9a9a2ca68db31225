"""Word lists, patterns and tables that decide results and may not drift.

Nothing here is logic. Patterns are written for Java regular expressions: ``{B}`` stands for
an ASCII word boundary and ``{S}`` for one white-space character, both filled in by
``text.pattern``.
"""

# Letters that Unicode does not decompose but keys must fold.
FOLDED_LETTERS = {"ø": "o", "æ": "ae", "ß": "ss", "ð": "d", "þ": "th", "đ": "d", "ł": "l", "œ": "oe"}

# Names of the ways a row can be found, best first, and the key rewritings.
HOWS = [
    "exact", "version", "spelling", "artist-scoped", "lead-scoped", "collab-scoped", "title-first", "near", "loose",
]
REWRITES = [
    "artist-article-added", "title-article-added", "title-article-dropped", "annotation-stripped",
    "ampersand-spelled-out", "title-contraction",
]
PROPOSED_RANK = 99
LIVE_PENALTY = 50_000_000
VARIANT_PENALTY = 40_000_000
TITLE_RELEASE_BONUS = 1_000_000
EARLIEST_YEAR = 1890

# Brackets and articles.
TRAILING_BRACKET = r"{S}*[(\[]([^()\[\]]*)[)\]]{S}*\z"
LEADING_ARTICLE = r"\A(?i:the|a|an){S}+"
ARTIST_ANNOTATION = (
    r"(?i){S}*[(\[]([^()\[\]]*(?:{B}soundtrack{B}|{B}fellowship{B}|{B}jungle book{B}|{B}disney{B}"
    r"|{B}eurovision{B}|{B}from{B})[^()\[\]]*)[)\]]{S}*\z"
)

# Words and signs between the artists of a joint credit.
CREDIT_JOIN = r"(?i){S}+(?:feat\.?|ft\.?|featuring|with|duet with|med|vs\.?|versus|and|x){S}+|{S}*[&,+/]{S}*"
CREDIT_JOIN_GREEDY = (
    r"(?i){S}*(?:&|,|/|{B}feat{B}\.?|{B}ft{B}\.?|{B}and{B}|{B}och{B}|{B}med{B}|{B}vs{B}\.?|{B}with{B}){S}*"
)
CREDIT_JOIN_NARROW = r"(?i){S}+(?:&|and|feat\.?|ft\.?|featuring|with|vs\.?){S}+"

# Titles.
LANGUAGES = [
    "english", "swedish", "finnish", "german", "spanish", "french", "italian", "norwegian", "danish", "dutch",
    "portuguese",
]
MASTER_MARKERS = [
    "mix", "remix", "rmx", "emix", "blend", "revision", "rework", "instrumental", "acoustic", "live", "karaoke",
    "backing track", "edit", "version", "reprise", "radio", "extended", "demo", r"remaster(?:ed)?", r"re-?recorded",
    "unplugged", "dub", "thunderdub", "a cappella", "single", "from", "mixtape", r"(?:the{S}+)?video", r"sessions?",
    r"slowed(?:{S}*\+{S}*reverb)?", "chopped", "hook", "intro", "outro", "fade", "dirty", "anthem", "disctruct",
    r"super{S}+clean", "clean", "bootleg", r"sped{S}*up", r"speed{S}*up", "reverb", r"mash(?:[- ]?up)?",
]
SUBTITLE_MARKERS = [
    "are made of", "looks like", "call me by", r"part{S}*[0-9]", r"vols?\.?", "volume", "theme", "aka",
    r"a\.k\.a\.?", "song", "suite", "movement",
]
VARIANT_WORDS = [
    "remix", "rmx", "emix", "mix", "blend", "revision", "rework", "dub", r"mash(?:[- ]?up)?", "bootleg", "acoustic",
    "instrumental", "karaoke", "mixtape", r"(?:the{S}+)?video", r"sessions?", "slowed", "chopped", "hook",
]
REMIXER_NAMES = r"\A[A-Z0-9][\w'’.&]*?(?:{S}+[A-Z0-9][\w'’.&]*)+\z"

# Releases.
DATED_RELEASE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}{S}*:"
LIVE_RELEASE_WORDS = [
    "live", "unplugged", "bootleg", r"live{S}+lounge", r"in{S}+concert", r"the{S}+concert",
    r"concert{S}+celebration", "concert",
]
LIVE_VENUES = [
    "radio city", "madison square", "wembley", "stadium", "arena", "amphitheatre", "amphitheater", "festival",
    "concert hall", "high school", "sof[iı]", "o₂", "o2", r"mtv{S}+history",
]

# Audit patterns.
AUDIT_MASTER_WORDS = [
    "remix", "rmx", "emix", "blend", "bootleg", "thunderdub", "edit", "version", "mix", "dub", "anthem",
    "instrumental", "karaoke", "acoustic", "live", "demo", "unplugged", "radio", "extended", "fade", "clean",
    "dirty", r"super{S}+clean",
]
AUDIT_SUBTITLES = ["are made of", "looks like", "call me by", r"part{S}*[0-9]", r"vols?\.?", "volume", "theme", "aka"]
AUDIT_REMIXER = r"(?i)\([^)]*(?:'s|’s){S}+[^)]*(?:mix|remix|edit|version|dub|emix|anthem)[^)]*\)"
AUDIT_YEAR = r"\((?:19|20)[0-9]{2}\){S}*\z"
AUDIT_LIVE_RELEASES = [
    "live", "concert", "unplugged", "bootleg", "radio city", "madison square", "wembley", "mtv history",
    "wildlife concert", "jerusalem concert", "montreux", "bogart", "royal albert", "permission to dance", "live usa",
    "firefest",
]

# Second opinions and candidates.
KARAOKE_JUNK = [
    "karaoke", "tribute", "originally performed", "made famous", "made popular", "in the style of",
    r"sing[- ]?along", "backing track", r"midi(?:fine)?", "party tyme", "ameritz", "stagesound",
]
TRIBUTE_WORDS = ["tribute", "cover band", "covers band", "karaoke"]

# HTML entities a listing may hold.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–",
    "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "deg": "°",
}

# Browsing.
LANGUAGE_LABELS = {
    "eng": "English", "swe": "Swedish", "fin": "Finnish", "spa": "Spanish", "ita": "Italian", "fra": "French",
    "nor": "Norwegian", "nob": "Norwegian", "deu": "German", "nld": "Dutch", "jpn": "Japanese", "kor": "Korean",
    "mul": "Multiple", "nap": "Neapolitan", "pan": "Punjabi", "zxx": "Instrumental",
}
SPECIAL_GENRES = {
    "r&b": "R&B", "hip hop": "Hip hop", "drum and bass": "Drum and bass", "a cappella": "A cappella",
}
COLLECTION_KINDS = ["decade", "genre", "category", "from", "lang"]
FEATURED = [
    ("decade", "1980"), ("decade", "1990"), ("decade", "2000"), ("lang", "swe"), ("category", "Melodifestivalen"),
    ("genre", "pop"), ("genre", "rock"), ("category", "Disney"),
]
FACET_FLOOR = 20
GENRE_TILES = 40
SEARCH_SONGS = 80
SEARCH_ARTISTS = 6
PAGE_ROWS = 80

# Shows whose songs belong to a category without being filed there.
SHOWS_BY_CATEGORY = {
    "Disney": [
        "Aladdin", "Beauty and the Beast", "Cinderella", "Frozen", "Frozen II", "Hercules", "High School Musical",
        "High School Musical 2", "Lady and the Tramp", "Mary Poppins", "Mulan", "Peter Pan", "Pocahontas", "Tarzan",
        "The Jungle Book", "The Lion King", "The Little Mermaid", "Toy Story",
    ],
    "James Bond": [
        "A View to a Kill", "Die Another Day", "For Your Eyes Only", "GoldenEye", "Goldfinger", "Licence to Kill",
        "Octopussy", "The Living Daylights", "The Spy Who Loved Me", "Thunderball",
    ],
    "Musical": [
        "Annie", "Annie Get Your Gun", "Bye Bye Birdie", "Cabaret", "Chess", "Dreamgirls", "Fiddler on the Roof",
        "Funny Girl", "Gigi", "Grease", "Hair", "Hamilton", "High School Musical", "High School Musical 2",
        "Jekyll & Hyde", "Jesus Christ Superstar", "Joseph", "Mary Poppins", "Moulin Rouge!", "My Fair Lady",
        "Oliver!", "Pippin", "South Pacific", "The Fantasticks", "The Music Man", "The Phantom of the Opera",
        "The Rocky Horror Picture Show", "The Sound of Music", "West Side Story",
    ],
}
CONTESTS = ["Eurovision", "Melodifestivalen"]
