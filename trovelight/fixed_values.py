"""Lists, limits and messages that results must show exactly as written here."""

# Reciprocal rank fusion.
RRF_K = 60

# Characters that stand for one token when a file's description budget is measured.
CHARS_PER_TOKEN = 4

# Metadata limits.
TITLE_MAX_CHARS = 120
DESCRIPTION_MAX_CHARS = 1000
VISIBLE_TEXT_MAX_CHARS = 10_000
TAG_MAX_CHARS = 50
IMAGE_TAGS_KEPT = 20
TEXT_TAGS_KEPT = 15
ERROR_MAX_CHARS = 1000

# Closed vocabularies.
IMAGE_TYPES = ["photo", "screenshot", "document", "diagram", "other"]
ASSET_TYPES = ["image", "text"]
STATUSES = ["pending", "processing", "ready", "failed"]
UNIT_KINDS = ["metadata", "filename", "image", "visible_text", "content"]
MATCH_KINDS = ["exact", "partial", "semantic"]
ORDERS = ["relevance", "exact_first", "tiered", "blended"]

# Tags every file of a kind gets.
TEXT_TYPE_TAGS = ["text", "text file", "document"]
IMAGE_TYPE_TAGS = {
    "photo": ["image", "picture", "photo", "photograph"],
    "screenshot": ["image", "picture", "screenshot"],
    "document": ["image", "picture", "document", "scan"],
    "diagram": ["image", "picture", "diagram", "drawing"],
    "other": ["image", "picture"],
}

# Names of collections.
COLLECTION_NAME = "^[a-z0-9_-]{1,64}$"

# Messages shown to users.
EMPTY_FILE = "The file is empty."
UNSUPPORTED_FILE = (
    "Unsupported file type: only JPEG, PNG and WebP images and UTF-8 text files are accepted."
)
FILE_TOO_LARGE = "File is larger than the {megabytes} MB limit."
INVALID_ANSWER = "The AI model's answer did not match the expected format."
LEASE_USED_UP = "Processing did not finish within the lease {attempts} times."
NOT_FAILED = "Only a failed asset can be retried; this one is {status}."
ASSET_NOT_FOUND = "Asset not found."
BLANK_QUERY = "q: must not be blank."

# The stand-in description model.
INVALID_MARKER = "invalid"
STAND_IN_MODEL = "fake-vision"
UNKNOWN_IMAGE = "An uploaded image."
UNKNOWN_TEXT = "An uploaded text file."

# An image header that claims more pixels than this is refused.
MAX_IMAGE_PIXELS = 178_956_970

# Match explanation.
SHORTEST_MARKED_WORD = 2
CONTEXT_BEFORE_MATCH = 40
IMAGE_TEXT_EXCERPT = 160
PASSAGE_EXCERPT = 300

# The English stop words of the Snowball project.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now
""".split()
