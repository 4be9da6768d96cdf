"""Fixed values that results depend on: names, severities, patterns."""

# Built-in capabilities, their labels and severities.
CAPABILITIES = {
    "host:root": ("Host root (privileged container / escape)", 10),
    "host:docker": ("Docker daemon access (host root)", 10),
    "host:pid": ("Host PID namespace", 8),
    "host:network": ("Host network namespace", 6),
    "k8s:kubeconfig": ("Kubernetes API via kubeconfig", 8),
    "exec:shell": ("Shell command execution", 7),
    "exec:code": ("Arbitrary code execution", 7),
    "data:sql": ("SQL database access", 6),
    "net:http": ("Outbound HTTP requests", 3),
}
SECRET_SEVERITY, NETWORK_SEVERITY = 5, 2

# Words that make a name a credential, and endings that undo it.
CREDENTIAL_WORDS = ("key", "token", "secret", "passw", "pwd", "credential", "auth", "private", "dsn", "conn")
NOT_CREDENTIAL_ENDINGS = ("_FILE", "_PATH", "_URL_PATH", "KEYBOARD", "AUTHOR")
LLM_KEYS = (
    "OPENAI_API_KEY", "ANTHROPIC_API_KEY", "AZURE_OPENAI_API_KEY", "GOOGLE_API_KEY", "GEMINI_API_KEY",
    "MISTRAL_API_KEY", "COHERE_API_KEY", "GROQ_API_KEY", "HUGGINGFACEHUB_API_TOKEN", "TOGETHER_API_KEY",
)

# What the directory walk takes and skips.
SKIPPED_FOLDERS = (".git", "node_modules", ".venv", "venv", "__pycache__", ".tox", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages")
SUFFIXES = (".yml", ".yaml", ".json", ".py")
MAX_BYTES = 2_000_000
# Fixed value: names of Compose files.
COMPOSE_NAME = r"(?s:(docker-)?compose.*\.ya?ml)\Z"

# Container capabilities that amount to host root.
ESCAPE_CAPS = ("ALL", "SYS_ADMIN", "SYS_MODULE", "SYS_PTRACE", "DAC_READ_SEARCH", "SYS_RAWIO")

# Kubernetes kinds, verbs and resources.
WORKLOAD_KINDS = ("Pod", "Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob")
BINDING_KINDS = ("RoleBinding", "ClusterRoleBinding")
HANDLED_KINDS = (*WORKLOAD_KINDS, *BINDING_KINDS, "Role", "ClusterRole", "ServiceAccount", "Secret")
READ_VERBS = ("get", "list", "watch", "*")
ESCALATING_RESOURCES = ("pods", "pods/exec", "pods/attach", "deployments", "daemonsets", "statefulsets", "jobs", "cronjobs", "serviceaccounts/token", "nodes/proxy")
RBAC_RESOURCES = ("roles", "clusterroles", "rolebindings", "clusterrolebindings")
RBAC_VERBS = ("bind", "escalate", "impersonate")
EDIT_VERBS = ("get", "list", "watch", "create", "update", "patch", "delete")
#: Cluster roles that manifests name without defining: (verbs, resources).
BUILTIN_ROLES = {
    "cluster-admin": (("*",), ("*",)),
    "admin": (EDIT_VERBS, ("*",)),
    "edit": (EDIT_VERBS, ("*",)),
    "view": (("get", "list", "watch"), ("pods", "services", "configmaps", "deployments")),
}

# Launch commands of MCP servers.
SHELLS = ("sh", "bash", "zsh", "fish", "pwsh", "powershell", "cmd", "cmd.exe")
SHELL_HINTS = ("server-shell", "mcp-shell", "shell-server", "server-commands", "desktop-commander", "terminal", "mcp-server-shell")
SQL_HINTS = ("postgres", "mysql", "sqlite", "mssql", "server-sql", "bigquery", "snowflake")
HTTP_HINTS = ("server-fetch", "mcp-server-fetch", "puppeteer", "playwright", "browser", "brave-search")
K8S_HINTS = ("kubernetes", "kubectl", "k8s")
CLIENTS = {"claude_desktop_config.json": "Claude Desktop", ".mcp.json": "Claude Code", "mcp.json": "MCP client"}

# Tool types of registries. A file type says whether it writes.
REGISTRY_TYPES = {
    "shell": "exec:shell", "bash": "exec:shell", "terminal": "exec:shell",
    "python": "exec:code", "code": "exec:code", "repl": "exec:code",
    "http": "net:http", "requests": "net:http", "web": "net:http", "browser": "net:http",
    "sql": "data:sql", "database": "data:sql",
    "kubernetes": "k8s:kubeconfig", "kubectl": "k8s:kubeconfig", "docker": "host:docker",
}
REGISTRY_FILES = {"filesystem": True, "file": True, "files": True, "fs_read": False}

# Names in Python agent code and what they give.
TOOL_CLASSES = {
    "ShellTool": "exec:shell", "BashProcess": "exec:shell", "TerminalTool": "exec:shell",
    "PythonREPLTool": "exec:code", "PythonAstREPLTool": "exec:code", "PythonREPL": "exec:code",
    "RequestsGetTool": "net:http", "RequestsPostTool": "net:http", "RequestsPutTool": "net:http",
    "RequestsPatchTool": "net:http", "RequestsDeleteTool": "net:http", "RequestsToolkit": "net:http",
    "SQLDatabaseToolkit": "data:sql", "QuerySQLDataBaseTool": "data:sql",
    "QuerySQLDatabaseTool": "data:sql", "InfoSQLDatabaseTool": "data:sql",
    "FileManagementToolkit": "fs:write", "WriteFileTool": "fs:write", "DeleteFileTool": "fs:write",
    "MoveFileTool": "fs:write", "CopyFileTool": "fs:write",
    "ReadFileTool": "fs:read", "ListDirectoryTool": "fs:read", "FileSearchTool": "fs:read",
}
LOADED_TOOLS = {"terminal": "exec:shell", "python_repl": "exec:code", "requests": "net:http", "requests_all": "net:http", "requests_get": "net:http", "requests_post": "net:http"}
FACTORIES = {
    "initialize_agent": None, "AgentExecutor": None, "create_react_agent": None,
    "create_openai_functions_agent": None, "create_openai_tools_agent": None,
    "create_tool_calling_agent": None, "create_structured_chat_agent": None,
    "create_sql_agent": "data:sql", "create_python_agent": "exec:code",
    "create_pandas_dataframe_agent": "exec:code", "create_csv_agent": "exec:code",
}
BODY_CALLS = {"subprocess": "exec:shell", "os.system": "exec:shell", "os.popen": "exec:shell", "eval": "exec:code", "exec": "exec:code", "requests": "net:http", "httpx": "net:http", "urllib.request": "net:http"}
AGENT_WORDS = ("langchain", "@tool", "langgraph")

# Keywords of agent factories that take tools, and wrappers of a function.
TOOL_KEYWORDS = ("tools", "toolkit", "extra_tools")
TOOL_WRAPPERS = ("Tool", "StructuredTool", "from_function")

# Paths of a host. Below the first, access is severe, without a path boundary; the others amount to a capability.
SENSITIVE_PATHS = r"^(/etc|/root|/home|/var/lib|/var/run|/run|~|\$HOME)"
DOCKER_SOCKETS = ("/var/run/docker.sock", "/run/docker.sock")
HOST_ROOTS = ("/", "/proc", "/sys", "/dev")
BROAD_ROOTS = ("/", "~", "$HOME", ".")
BROAD_ROOT = r"^(/Users/[^/]+|/home/[^/]+|~)/?\n?\z"

# What is masked in arguments (user information of URLs, values of secret-like flags, opaque tokens).
URL_USER = r"(?U)(\w+://)[^/@\s]+@"
SECRET_FLAG = r"(?iuU)^(--?[\w.-]*(?:key|token|secret|passw|pwd|auth)[\w.-]*[=:])(?-U:.+)$"
OPAQUE = r"^[A-Za-z0-9_\-+/=.]{24,}$"

#: Labels that make a workload an agent, by default; scan() and the command line take others.
COMPOSE_AGENT_LABEL, K8S_AGENT_LABEL = "emberline.agent", "emberline.io/agent"
