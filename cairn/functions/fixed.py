"""Values that results depend on: fixed values, not design."""

# Words that retrieval drops after stemming.
RETRIEVAL_STOPS = ["a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "had", "has", "have", "how", "i", "in", "is", "it", "many", "me", "my", "of", "on", "or", "the", "to", "was", "were", "what", "when", "where", "which", "who", "with"]

# Words that date a text by themselves.
TEMPORAL_WORDS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "today", "yesterday", "tomorrow"]

# Words that packages and the session index drop ("n/a" matters to packages only and is no token).
PACKAGE_STOPS = ["the", "a", "an", "and", "or", "of", "in", "on", "for", "to", "was", "were", "is", "are", "i", "my", "me", "we", "you", "that", "this", "with", "from", "at", "by", "as", "be", "been", "have", "has", "had", "it", "its", "over", "past", "before", "after", "which", "what", "how", "many", "did", "do", "most", "based", "user", "stated", "none", "than", "then", "into", "about", "just", "only", "also", "not", "any", "all", "can", "could", "would", "should", "will", "within"]

# Words that coverage drops, and number words that anchor it.
COVERAGE_STOPS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "i", "in", "is", "it", "me", "my", "of", "on", "or", "our", "the", "to", "was", "we", "were", "with"]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]

# Question shapes, the first that matches.
ORDER_WORDS = r"\b(how long|before|after|first|last|earliest|latest|chronolog|in what order|when did)\b"
AGGREGATE_WORDS = r"\b(how many|total|sum|combined|altogether|list all|which .* most|what .* did i|compare)\b"
UPDATE_WORDS = r"\b(now|currently|changed|change in|updated|used to|previously|compared with|compared to)\b"

# Cues of personal signals, in order.
SIGNALS = [
    ("first_person", r"\b(?:i|i'm|i've|i'd|i'll|me|my|mine|we|we're|we've|we'd|we'll|our|ours)\b"),
    ("quantity", r"(?:\b\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?\b|\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b)"),
    ("time", r"\b(?:today|yesterday|tomorrow|last|next|ago|minutes?|hours?|days?|weeks?|months?|years?|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|june|july|august|september|october|november|december)\b"),
    ("change", r"\b(?:now|currently|already|still|started|stopped|increased|decreased|grew|changed|finished|completed|attended|visited|graduated|received|replaced|moved|got|bought|purchased|paid|ordered|sold|donated|planted|spent)\b"),
    ("completed_event", r"\b(?:attended|baked|built|bought|completed|cooked|created|finished|joined|left|made|met|ordered|paid|planted|received|returned|sold|took|traveled|visited|went|won)\b"),
    ("relationship", r"\b(?:mom|mother|dad|father|parent|parents|sister|brother|sibling|partner|wife|husband|friend|child|children|son|daughter|pet|dog|cat|horse)\b"),
    ("possession_or_project", r"\b(?:my|our)\s+[\p{L}\p{N}_'-]+|\b(?:project|plan|trip|work|home|apartment|garden|account|subscription|device)\b"),
]
# What each cue weighs, and the weights from which a signal is of high or medium priority.
SIGNAL_WEIGHTS = {"quantity": 2, "time": 2, "change": 2, "completed_event": 2, "relationship": 1, "possession_or_project": 1}
HIGH, MEDIUM = 4, 2

# Text that speaks of what is not so.
UNSAFE_CONTEXT = r"\b(?:hypothetical|hypothetically|imagine|imagining|pretend|roleplay|role-play|fiction|fictional|write (?:a|the) story|suppose that)\b"
TEMPORAL_QUESTION = r"\b(?:before|after|ago|when|how long|days?|weeks?|months?|years?)\b"

# Ranking constants.
BM25_K1, BM25_B, TEMPORAL_BOOST = 1.5, 0.9, 0.15
RRF_K = 60

# What a secret looks like, and names of fields that hold one.
SECRET_VALUE = r"(?i)(sk-[a-z0-9_-]{12,}|AIza[a-z0-9_-]{12,}|Bearer\s+[a-z0-9._-]{12,})"
SECRET_FIELDS = ["api_key", "authorization", "authorization_header", "auth_header", "bearer", "secret", "password", "access_token", "refresh_token", "id_token"]

# The suffix rules of the English stemmer, in order; the first that fits decides its step.
STEM_STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEM_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEM_STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# The stemmer's own tests. A y that is not the first letter counts as a vowel; a syllable is closed if it
# ends consonant, vowel, consonant, the last not w, x or y, and a middle y counts in words of four letters or more.
HOLDS_VOWEL = r"[aeiou]|.[yY]"
CLOSED_SYLLABLE = r"[^aeiou][aeiou][^aeiouwxyY]$|.[^aeiou][yY][^aeiouwxyY]$"

# The answer that stands in for a blank one, dollars a million tokens in and out, answer modes by type.
UNAVAILABLE = "The available memory does not contain this information."
ANSWER_PRICES = (0.05, 0.40)
ANSWER_MODES = [
    ("temporal-reasoning", "temporal_comparison"), ("knowledge-update", "knowledge_update"), ("multi-session", "multi_session"),
    ("single-session-preference", "preference"), ("single-session-assistant", "assistant_answer"),
]

# Keys of a tree, those that would reach an object's own machinery, those of transcripts, and empty updates.
SNAKE_CASE = r"[a-z][a-z0-9]*(?:_[a-z0-9]+)*"
DANGEROUS_KEYS = ["__proto__", "prototype", "constructor"]
FORBIDDEN_KEYS = ["master", "master_graph", "context", "schema_version", "revision", "provenance", "provenance_by_pointer", "session", "sessions", "session_id", "turn", "turns", "role", "content", "message", "messages", "batch"]
NOTHING_NEW = r"\bno new (?:durable )?(?:information|memory)\b"

# Words that mark no name at a question's start, and endings of contractions.
FRAMING_WORDS = ["a", "an", "are", "can", "could", "describe", "did", "do", "does", "explain", "give", "had", "has", "have", "how", "i", "identify", "is", "list", "me", "my", "our", "please", "should", "tell", "the", "us", "was", "we", "were", "what", "when", "where", "which", "who", "why", "would"]
CONTRACTIONS = ["d", "ll", "m", "re", "s", "ve"]

# Names and quotes as a question shows them, and what a restatement wraps around it.
CAPITALISED = r"\p{Lu}[\p{L}\p{N}]*(?:[-'’][\p{L}\p{N}]+)*"
QUOTED = r"[\"“]([^\"”\n]{2,120})[\"”]"
CONTRACTED = r"^(.+?)['’](\p{L}+)$"
WRAPPERS = [r"^(?:the )?user (?:asked|asks)\s+", r"^(?:the )?(?:question|query)(?: is| was| asked| asks)?\s+"]

# Characters beside which a text is in compatibility form: not ASCII, nor Latin letters that NFKC leaves alone.
MAY_CHANGE = "[^\\x00-\\x7f¡-§©«¬®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž]"

# Bytes of a final package, and characters that count as a token.
PACKAGE_BYTES, CHARS_PER_TOKEN = 36_000, 4

#: Headings and sentences of formatted packages and digests.
SELECTED_HEADING = "## SELECTED (matched the question)"
SUPPORTING_HEADING = "## SUPPORTING (same sessions; use when they bear on the question)"
NO_TURNS = "## NO MATCHING TURNS FOUND\n(empty selected set; do not invent members)"
FACTS_HEADING = "## FACTS (normalized from the context package)"
CONFLICTS_HEADING = "## CONFLICTS (same entity, disagreeing claims — do not resolve)"
MEMBERS_HEADING = "## SET MEMBERS (candidate members for count/order questions)"
OMITTED_HEADING = "## OMITTED / UNCERTAIN"

#: The bound of an excerpt in UTF-16 units, the share of its head, and the mark between head and tail.
EXCERPT_UNITS = 600
HEAD_SHARE = 0.65
OMISSION = "\n…\n"

#: Fixed value: what stands where no span was found.
NO_SPANS = "(no memory retrieved)"
