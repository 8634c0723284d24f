"""Word lists that must equal the reference's for right results.

These are stated plainly, in their natural order.  They are kept as Python
tuples and turned into Spark array literals by ``functions.paths``; callers may
pass their own lists to every job instead.
"""

# --- fixed values -----------------------------------------------------------
# Common directory names whose path tokens weigh 0.2 instead of 1.0.
NOISE_TOKENS = (
    "app", "src", "lib", "resources", "assets", "main", "index", "mod", "bin",
    "pkg", "internal", "common", "shared",
)

# Role words that say what kind of file it is, not what it is about.
TYPE_WORDS = (
    "controller", "model", "view", "service", "repository", "factory", "helper",
    "manager", "handler", "test", "spec", "dto", "dao", "middleware", "component",
    "provider", "resolver", "presenter", "interactor", "usecase", "query",
    "command", "listener", "observer",
)

# File stems with no domain meaning of their own; the parent folder names it.
GENERIC_STEMS = (
    "index", "show", "create", "edit", "delete", "update", "store", "main",
    "home", "base", "default", "init", "bootstrap",
)

# Per-language module-path noise.
RUST_NOISE = ("crate", "super", "self", "std", "core", "alloc", "proc_macro")
JAVA_NOISE = (
    "com", "org", "net", "io", "gov", "edu", "java", "javax", "android", "kotlin",
    "sun", "oracle", "apache", "google",
)
CSHARP_NOISE = ("system", "microsoft", "windows", "azure")
PHP_NOISE = (
    "illuminate", "laravel", "symfony", "doctrine", "league", "monolog", "guzzle",
    "psr", "zend",
)

# Prefixes that mark a quoted string as an external link, not a file reference.
EXTERNAL_PREFIXES = (
    "http://", "https://", "//", "mailto:", "tel:", "javascript:", "data:", "#",
)

# Extension -> language (case-sensitive, last extension only).
LANGUAGE_BY_EXTENSION = {
    "py": "python", "pyw": "python", "pyi": "python",
    "rs": "rust",
    "java": "java", "kt": "java", "kts": "java",
    "cs": "csharp",
    "php": "php", "phtml": "php",
}

# PHP: a line is searched for view / route calls only if its lower-cased text
# contains one of these hints.
VIEW_HINTS = (
    "view(", "view()->", "@extends(", "@include(", "@includeif(", "@includewhen(", "@includeunless(",
    "@includefirst(", "@component(", "@each(", "@livewire(",
)
ROUTE_HINTS = ("route(",)

# PHP view calls searched on hinted lines, in order; the two marked forms take
# their second argument, all others their first.
VIEW_CALLS = (
    "view(", "view()->first(", "view()->make(", "View::make(", "View::first(",
    "response()->view(", "redirect()->view(", "Route::view(", "@extends(",
    "@include(", "@includeif(", "@includewhen(", "@includeunless(",
    "@includefirst(", "@component(", "@each(", "@livewire(",
)
VIEW_CALLS_SECOND_ARG = ("Route::view(", "@includewhen(")
ROUTE_CALLS = ("route(", "to_route(", "->route(", "redirect()->route(")

# Scoring constants.
NOISE_WEIGHT = 0.2
RECENCY_HOURS = 69.3            # exp(-hours / 69.3): half-life 48 h
MIN_GROUP, MAX_GROUP = 2, 64    # change groups outside this size are ignored
REF_SHARE_MIN, REF_CAP = 0.5, 1.5
W_PHP_USE, W_CLASS, W_COMPONENT = 1.05, 1.25, 1.35
W_VIEW, W_ROUTE, W_ROUTE_FILE = 1.40, 1.15, 1.10
PARTIAL_FACTOR = 0.8
# -----------------------------------------------------------------------------
