"""Fixed values that are part of the results, kept together in one place."""

# Names that make a folder a site, best first.
ENTRY_NAMES = ["OUVRIR.html", "ouvrir.html", "index.html", "index.htm"]

# Longest text read from one file, in bytes.
TEXT_LIMIT = 16 * 1024 * 1024

# Longest WARC record accepted, in bytes.
MAX_WARC_RECORD = 512 * 1024 * 1024

# Caps that reports and listings show ("n shown of total").
SOURCES_SHOWN = 20
PATHS_SHOWN = 400
BROKEN_SHOWN = 300
SEARCH_SHOWN = 40
LISTING_SHOWN = 400

# Prompt building: documents per question and characters per document.
BATCH_MAX = 8
DOC_CHARS = 12_000

# Deepest wrapper folder looked into.
WRAPPER_DEPTH = 64

# Seconds of silence after which an unfinished chat answer is given up.
CHAT_SILENCE_SECONDS = 600

# Wording used in results.
DEFAULT_QUESTION = "Résume."
DOCUMENTS_HEADING = "Documents :"
FILE_HEADING = "## fichier: "
CUT_NOTICE = "[Document tronqué à 12 000 caractères.]"
QUESTION_HEADING = "Question : "
ENTRY_SOURCE = "entrée"

# Characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# File extension to media type, for the kinds of file sites and notes hold.
MEDIA_TYPES = {
    "html": "text/html",
    "htm": "text/html",
    "shtml": "text/html",
    "xhtml": "application/xhtml+xml",
    "css": "text/css",
    "csv": "text/csv",
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "xml": "text/xml",
    "c": "text/plain",
    "h": "text/plain",
    "cc": "text/x-c++src",
    "cpp": "text/x-c++src",
    "cxx": "text/x-c++src",
    "hh": "text/x-c++hdr",
    "hpp": "text/x-c++hdr",
    "hxx": "text/x-c++hdr",
    "vtt": "text/vtt",
    "ics": "text/calendar",
    "js": "text/javascript",
    "mjs": "text/javascript",
    "json": "application/json",
    "wasm": "application/wasm",
    "pdf": "application/pdf",
    "epub": "application/epub+zip",
    "zip": "application/zip",
    "gz": "application/gzip",
    "svg": "image/svg+xml",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "avif": "image/avif",
    "bmp": "image/bmp",
    "ico": "image/x-icon",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "mp3": "audio/mpeg",
    "ogg": "audio/ogg",
    "wav": "audio/wav",
    "mp4": "video/mp4",
    "webm": "video/webm",
    "ttf": "font/ttf",
    "otf": "font/otf",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "rtf": "text/rtf",
    "tsv": "text/tab-separated-values",
    "yaml": "text/x-yaml",
    "yml": "text/x-yaml",
    "eot": "application/vnd.ms-fontobject",
    "map": "application/json",
    "rss": "application/rss+xml",
    "atom": "application/atom+xml",
    "jsonld": "application/ld+json",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text",
    "tar": "application/x-tar",
    "bz2": "application/x-bzip2",
    "7z": "application/x-7z-compressed",
    "rar": "application/vnd.rar",
    "heic": "image/heic",
    "m4a": "audio/mp4",
    "aac": "audio/aac",
    "flac": "audio/flac",
    "oga": "audio/ogg",
    "opus": "audio/opus",
    "mid": "audio/midi",
    "ogv": "video/ogg",
    "mov": "video/quicktime",
    "avi": "video/x-msvideo",
    "mkv": "video/x-matroska",
    "mpeg": "video/mpeg",
    "mpg": "video/mpeg",
    "m4v": "video/x-m4v",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"

# Extensions that are text whatever their media type says.
TEXT_EXTENSIONS = [
    "c", "h", "cc", "hh", "cpp", "hpp", "cxx", "hxx", "md", "csv", "svg", "mjs",
]
