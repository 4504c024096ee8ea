"""Word lists, limits and formats that results depend on."""

# --- fixed values: source extensions and pruned folders -------------------
SOURCE_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mts", "cts", "svelte", "astro", "vue"]
GATE_EXTENSIONS = SOURCE_EXTENSIONS + ["mjs", "cjs"]
PRUNED_SOURCE_FOLDERS = ["node_modules", "dist", "build", "out", "coverage"]
PRUNED_PACKAGE_FOLDERS = [
    "node_modules", ".git", ".hg", ".svn", ".cache", ".turbo", ".parcel-cache",
    ".next", ".nuxt", ".vite", "coverage", "target",
]
RUNTIME_EXTENSIONS = ["js", "mjs", "cjs", "jsx", "ts", "tsx", "mts", "cts"]

# --- fixed values: Node built-in modules ----------------------------------
NODE_MODULES = [
    "assert", "assert/strict", "async_hooks", "buffer", "child_process", "cluster",
    "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns",
    "dns/promises", "domain", "events", "fs", "fs/promises", "http", "http2", "https",
    "inspector", "inspector/promises", "module", "net", "os", "path", "path/posix",
    "path/win32", "perf_hooks", "process", "punycode", "querystring", "readline",
    "readline/promises", "repl", "stream", "stream/consumers", "stream/promises",
    "stream/web", "string_decoder", "timers", "timers/promises", "tls", "trace_events",
    "tty", "url", "util", "util/types", "v8", "vm", "wasi", "worker_threads", "zlib",
]
NODE_PREFIXED_ONLY = ["node:sea", "node:sqlite", "node:test", "node:test/reporters"]
HOST_MODULES = ["vscode", "electron"]

# --- fixed values: asset families -----------------------------------------
CSS_EXTENSIONS = ["css", "scss", "sass", "less", "styl", "stylus", "pcss", "postcss"]
WASM_EXTENSIONS = ["wasm"]
FONT_EXTENSIONS = ["woff", "woff2", "ttf", "otf", "eot"]
UNMEASURED_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "svg", "webp", "avif", "ico", "bmp", "mp4",
    "webm", "mp3", "wav", "ogg", "node",
]

# --- fixed values: diagnostic stages --------------------------------------
TRANSIENT_STAGES = [
    "panic", "timeout", "engine_gone", "asset_io", "entry_metadata", "compression",
]
DURABLE_STAGES = [
    "resolve", "parse", "link", "generate", "output_shape", "module_graph_limit",
    "missing_export", "ambiguous_export", "external", "uncounted_assets",
    "imprecise_assets", "package_validation", "package_resolution", "package_manifest",
    "entry_resolution", "oversized_entry", "minify", "types_only",
    "native_binary_only", "native_binary",
]
NON_BUDGETABLE_STAGES = ["imprecise_assets"]

# --- fixed values: platform tokens of native packages ---------------------
OS_TOKENS = [
    "win32", "windows", "darwin", "linux", "freebsd", "openbsd", "netbsd", "dragonfly",
    "sunos", "solaris", "aix", "android", "openharmony", "haiku", "cygwin", "wasi",
]
ARCH_TOKENS = [
    "x64", "x86_64", "amd64", "arm64", "aarch64", "ia32", "x86", "arm", "armv6", "armv7",
    "armv7l", "ppc", "ppc64", "ppc64le", "s390", "s390x", "riscv64", "loong64",
    "loongarch64", "mips", "mipsel", "mips64", "mips64el", "wasm32", "universal",
]
LIBC_TOKENS = ["musl", "gnu", "gnueabi", "gnueabihf", "eabi", "eabihf", "glibc", "msvc"]

# --- fixed values: manifest sections --------------------------------------
MANIFEST_SECTIONS = [
    "dependencies", "devDependencies", "peerDependencies", "optionalDependencies",
]

# --- fixed values: limits --------------------------------------------------
GRAPH_MAX_MODULES = 2_000
GRAPH_MAX_MODULE_BYTES = 20 * 1024 * 1024
GRAPH_MAX_TOTAL_BYTES = 100 * 1024 * 1024
TREESHAKE_RATIO = 0.95
TOP_MODULES = 10
TREEMAP_ROWS = 10
FILE_HISTORY_ROWS = 20
IMPORT_HISTORY_ROWS = 200
RETENTION_FLOOR_ROWS = 128
RETENTION_LOW_WATER = 0.9
BURST_GAP_MS = 250
BURST_LIMIT = 20
RESTART_WINDOW_MS = 10 * 60 * 1000
RESTART_LIMIT = 5
UNKNOWN_MAX_ATTEMPTS = 3
UNKNOWN_PERSIST_MS = 2_000
LATENCY_MIN_SAMPLES = 30
ACCURACY_TOLERANCE = 0.25

# --- fixed values: registry timing ----------------------------------------
REGISTRY_FRESH_MS = 6 * 60 * 60 * 1000
REGISTRY_NOT_FOUND_MS = 6 * 60 * 60 * 1000
REGISTRY_TRANSIENT_RETRY_MS = 5 * 60 * 1000
REGISTRY_RETRY_STEP_MS = 100
REGISTRY_MANUAL_COOLDOWN_MS = 10_000
REGISTRY_RETENTION_MS = 30 * 24 * 60 * 60 * 1000
REGISTRY_MAX_BYTES = 32 * 1024 * 1024
REGISTRY_BACKGROUND_PER_SECOND = 20
REGISTRY_MANUAL_PER_SECOND = 5
FRESH_RELEASE_MS = 24 * 60 * 60 * 1000

# --- fixed values: package substitutions ----------------------------------
SUBSTITUTIONS = [
    ("moment", 1, "dayjs", "Similar date API with a smaller common runtime footprint."),
    ("moment", 2, "date-fns", "Function-level imports can tree-shake well in ESM builds."),
    ("lodash", 1, "lodash-es", "ESM build gives bundlers better tree-shaking opportunities."),
    ("uuid/v4", 1, "uuid", "Modern uuid exports named helpers from the package root."),
]

# --- fixed values: the five sizes of a measurement ------------------------
SIZES = ["raw_bytes", "minified_bytes", "gzip_bytes", "brotli_bytes", "zstd_bytes"]
