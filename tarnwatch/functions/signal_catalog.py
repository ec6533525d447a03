"""Weighted signals of the content detectors, one table per detector.

Fixed values: signal types, their weights, patterns, modes and thresholds have to be these for equal scores.
A pattern that does not start with a flag group is case-sensitive. Mode "each" adds the weight for every match,
"once" for the first match of a type in a package. Scores are clamped to 100 before they meet flag and warn.
"""

from __future__ import annotations

from typing import NamedTuple


class Detector(NamedTuple):
    mode: str
    flag: int
    warn: int
    signals: dict[str, tuple[int, list[str]]]


D15 = Detector("each", 75, 55, {
    "oidc_token_access": (60, [
        r"process\.env\.OIDC_TOKEN", r"process\.env\.GITHUB_TOKEN", r"process\.env\.CI_JOB_JWT", r"process\.env\.ACTIONS_ID_TOKEN",
        r"process\.env\[['\"][A-Z_]*TOKEN['\"]\]",
    ]),
    "memory_introspection": (55, [r"\bptrace\s*\(", r"/proc/self/mem", r"\bmemfd_create\b"]),
})

_BPF = [r"bpf\s*\(", r"BPF_PROG_LOAD", r"BPF_MAP_CREATE", r"BPF_PROG_ATTACH", r"bpf_prog_get|bpf_map_get"]
D16 = Detector("each", 100, 70, {
    "ebpf_bytecode": (70, [r"eBPF", *_BPF]),
    "bpf_syscall": (65, _BPF),
    "kernel_hook": (70, [r"\bkprobes/", r"\btracepoints?/", r"\bsys_enter\b|\bsys_exit\b", r"\bBPF_KPROBE\b", r"\btracepoint__sys_"]),
    "syscall_hook": (75, [
        r"\bsys_open\b|\bsys_openat\b", r"\bsys_write\b|\bsys_writev\b", r"\bsys_read\b|\bsys_readv\b",
        r"\bsys_connect\b|\bsys_sendto\b", r"\bsys_execve\b|\bsys_fork\b",
    ]),
    "hiding_intent": (50, [r"(?i)\brootkit\b", r"(?i)\bhide\s*_\s*(process|file|network)\b", r"(?i)\bkernel\s+hook\b"]),
    "kernel_ffi": (50, [r"extern\s+\"C\"\s*\{", r"libc::"]),
})

D17 = Detector("each", 120, 70, {
    "capability_request": (70, [
        r"\bCAP_SYS_ADMIN\b", r"\bCAP_SYS_MODULE\b", r"\bCAP_NET_ADMIN\b", r"\bCAP_SYS_RESOURCE\b", r"\bCAP_SYS_PTRACE\b",
        r"\bcap_set_proc\b", r"\bprctl\b.*\bPR_SET_KEEPCAPS\b",
    ]),
    "exploit_reference": (20, [r"(?i)\bkernel\b.*\bexploit\b", r"(?i)\bprivilege\b.*\bescalation\b", r"(?i)\bbecome\b.*\broot\b"]),
    "setuid_attempt": (65, [r"\bsetuid\s*\(\s*0\s*\)", r"\bsetgid\s*\(\s*0\s*\)", r"\bsetcap\s+", r"chmod.*4755|chmod.*2755", r"\bsetfsgid\b|\bsetfsuid\b"]),
    "sudo_bypass": (75, [r"\bsudo\b.*NOPASSWD", r"\bsudoers\b.*\bappend\b", r"/etc/sudoers\b"]),
    "kernel_memory_access": (70, [r"/dev/mem\b", r"/dev/kmem\b", r"\bmmap\b.*\bdev/mem\b", r"\bptrace\b.*\bPTRACE_PEEKDATA\b"]),
    "kernel_module_load": (80, [r"\binsmod\b|\bmodprobe\b", r"\binit_module\b.*\bsyscall\b", r"\bfinit_module\b"]),
})

D18 = Detector("once", 170, 120, {
    "debugger_detection": (30, [
        r"(?i)process\.argv.*inspect", r"(?i)process\.argv.*debug\b", r"(?i)debugging\s*[=:].*true", r"(?i)process\.env\.NODE_DEBUG", r"(?i)typeof\s+global\.v8debug\b",
    ]),
    "execution_guard": (35, [
        r"(?i)if\s*\(\s*process\.env\..*SANDBOX", r"(?i)if\s*\(\s*process\.env\..*TEST\b", r"(?i)typeof\s+require\b.*undefined",
        r"(?i)process\.env\.CI\s*[=!]", r"(?i)process\.env\.npm_lifecycle_event\s*[=!]",
    ]),
    "package_validation": (8, [
        r"(?i)require\s*\(\s*['\"].*package\.json['\"]\s*\)", r"(?i)JSON\.parse.*fs\.readFileSync.*package\.json", r"(?i)crypto\.createHash.*JSON\.stringify.*pjson",
    ]),
    "environment_detection": (25, [
        r"(?i)process\.env\.TRAVIS\b|process\.env\.CIRCLE\b|process\.env\.GITHUB_ACTIONS\b", r"(?i)process\.env\.npm_lifecycle_event\s*[=!]", r"(?i)process\.env\.npm_config_user_agent",
    ]),
    "anti_tamper": (65, [r"(?is)throw\s+new\s+Error[^;]{0,40}\b(integrity|tamper|modified|checksum)\b"]),
    "file_modification_detection": (20, [r"(?i)fs\.statSync|fs\.stat\s*\(", r"(?i)mtimeMs|mtime|birthtime"]),
})

D19 = Detector("each", 160, 120, {
    "iife_pattern": (35, [
        r"\(\s*function\s*\([^)]*\)\s*\{[\s\S]*?\}\s*\)\s*\(", r"\(\s*async\s+function\s*\([^)]*\)\s*\{[\s\S]*?\}\s*\)\s*\(",
        r"\(\s*\(\s*\)\s*=>\s*\{[\s\S]*?\}\s*\)\s*\(", r"\(\s*async\s*\(\s*\)\s*=>\s*\{[\s\S]*?\}\s*\)\s*\(",
    ]),
    "toplevel_await": (45, [r"(?m)^const\s+\w+\s*=\s*await\s+"]),
    "module_hook": (40, [r"(?m)^process\.nextTick\s*\(", r"(?m)^setImmediate\s*\("]),
    "constructor_execution": (50, [r"new\s+\(\s*function\s*\([^)]*\)\s*\{[\s\S]*?\}\s*\)"]),
})

D20 = Detector("each", 170, 120, {
    "platform_enumeration": (20, [r"\bos\.platform\s*\(\s*\)", r"\bos\.arch\s*\(\s*\)", r"\bprocess\.platform\b", r"\bprocess\.arch\b", r"\bprocess\.version\b", r"\bos\.type\s*\(\s*\)"]),
    "user_enumeration": (25, [
        r"\bos\.homedir\s*\(\s*\)", r"\bprocess\.env\.HOME\b|\bprocess\.env\.USERPROFILE\b|\bprocess\.env\.USERNAME\b", r"\bos\.userInfo\s*\(\s*\)", r"(?i)child_process\.exec.*\bwhoami\b",
    ]),
    "network_check": (25, [r"\bdns\.lookup\b|\bdns\.resolve\b", r"\bsocket\.connect\b|\bnet\.connect\b"]),
    "cloud_detection": (45, [
        r"\bprocess\.env\.AWS_REGION\b|\bprocess\.env\.GCP_PROJECT\b|\bprocess\.env\.AZURE_SUBSCRIPTION\b", r"metadata\.google\.internal", r"(?i)\bkubernetes\b|\bK8S\b",
    ]),
    "directory_scan": (20, [r"\bfs\.readdirSync\s*\(", r"\bfs\.readdir\s*\("]),
    "tools_detection": (25, [r"\brequire\.resolve\s*\(", r"\bfs\.existsSync\s*\(\s*['\"].*node_modules"]),
})

D21 = Detector("each", 180, 120, {
    "self_deletion": (85, [
        r"(?i)\bfs\.unlink\s*\(\s*__filename", r"(?i)\bfs\.unlinkSync\s*\(\s*__filename", r"(?i)\bfs\.unlink\s*\(\s*module\.filename", r"(?i)\bfs\.unlinkSync\s*\(\s*module\.filename",
    ]),
    "package_json_manipulation": (75, [
        r"(?i)\bfs\.writeFileSync.*package\.json", r"(?i)\bfs\.writeFile\s*\(\s*['\"]package\.json", r"(?i)delete\s+.*scripts\.postinstall|delete\s+.*scripts\.preinstall",
    ]),
    "file_swap": (60, [r"(?i)\bfs\.renameSync|\bfs\.rename\s*\(", r"(?i)\bfs\.copyFileSync|\bfs\.copyFile\s*\("]),
    "log_cache_clear": (45, [r"(?i)\bfs\.rmSync|\bfs\.rmdirSync", r"(?i)\bfs\.unlink.*\.log|\bfs\.unlink.*\.cache|\bfs\.unlink.*\.tmp"]),
    "git_history_removal": (70, [r"(?i)child_process\.exec.*git\s+reset|child_process\.exec.*git\s+clean", r"(?i)child_process\.exec.*rm\s+-rf\s+\.git"]),
    "timestamp_manipulation": (50, [r"(?i)\bfs\.utimesSync|\bfs\.utimes\s*\("]),
})

D22 = Detector("once", 80, 60, {
    "claude_token_targeting": (90, [r"(?i)ANTHROPIC_API_KEY", r"(?i)ANTHROPIC_ORG_ID", r"(?i)process\.env\.ANTHROPIC", r"(?i)claude.*api.*key"]),
    "openai_token_targeting": (90, [
        r"(?i)OPENAI_API_KEY", r"(?i)OPENAI_ORG_ID", r"(?i)process\.env\.OPENAI", r"(?i)[\"'`]sk-[A-Za-z0-9]{20,}[\"'`]", r"(?i)OPENAI_API_KEY\s*[:=]\s*[\"'`]sk-",
    ]),
    "gemini_token_targeting": (85, [r"(?i)GOOGLE_API_KEY", r"(?i)GEMINI_API_KEY", r"(?i)process\.env\.GEMINI", r"(?i)google.*generative|gemini.*key"]),
    "mistral_token_targeting": (85, [r"(?i)MISTRAL_API_KEY", r"(?i)process\.env\.MISTRAL", r"(?i)mistral.*api.*key"]),
    "cursor_token_targeting": (85, [
        r"(?i)CURSOR_API_KEY", r"(?i)CURSOR_GITHUB_TOKEN", r"(?i)~/\.cursor/settings\.json", r"(?i)~/\.config/cursor/", r"(?i)process\.env\.CURSOR",
    ]),
    "ai_config_targeting": (80, [
        r"(?i)~/\.claude/mcp\.json", r"(?i)~/\.claude\.json", r"(?i)~/\.cursor/settings\.json", r"(?i)~/\.mistral/api\.key", r"(?i)~/\.config/cursor/", r"(?i)~/\.openai/", r"(?i)~/\.anthropic/",
    ]),
    "ai_token_exfiltration": (95, [
        r"(?i)(ANTHROPIC_API_KEY|OPENAI_API_KEY|GEMINI_API_KEY).*(?:fetch|axios|http\.post)", r"(?i)process\.env\.(?:CURSOR|MISTRAL).*(?:fetch|axios|http\.post)",
    ]),
    "ai_platform_enumeration": (75, [r"(?i)Object\.keys\s*\(\s*process\.env\s*\).*ANTHROPIC|OPENAI|GEMINI", r"(?i)for.*in.*process\.env.*if.*(?:CURSOR|MISTRAL)"]),
})

D23 = Detector("once", 85, 65, {
    "github_author_spoof": (95, [
        r"(?i)\"claude@users\.noreply\.github\.com\"", r"(?i)'claude@users\.noreply\.github\.com'", r"(?i)\"gpt@users\.noreply\.github\.com\"",
        r"(?i)\"openai@users\.noreply\.github\.com\"", r"(?i)\"anthropic@users\.noreply\.github\.com\"", r"(?i)\"cursorde@users\.noreply\.github\.com\"",
        r"(?i)\"gemini@users\.noreply\.github\.com\"",
    ]),
    "spoofed_git_commit": (90, [
        r"(?i)git\s+config\s+user\.email.*noreply\.github\.com", r"(?i)git\s+commit.*--author.*noreply\.github\.com",
        r"(?i)--author=\"claude@users\.noreply\.github\.com\"", r"(?i)--author=\"gpt@users\.noreply\.github\.com\"",
    ]),
    "force_push": (40, [r"(?i)git\s+push.*--force(?!-with-lease)", r"(?i)git\s+push.*-f\s+"]),
    "force_push_lease": (30, [r"(?i)git\s+push.*--force-with-lease"]),
    "ai_workflow_impersonation": (80, [
        r"(?i)([\"'])(?:Automated PR|AI-generated|Generated by Claude|OpenAI-assisted|Cursor-assisted|Gemini-generated)\1",
        r"(?i)([\"'])(?:feat: AI-powered|chore: automated by Claude|docs: generated by OpenAI)\1", r"(?i)[\"']This PR was created automatically[\"']",
    ]),
    "full_author_spoof_attack": (99, [
        r"(?i)--author=\"claude@users\.noreply\.github\.com\".*--force", r"(?i)git\s+config.*claude@users\.noreply.*git\s+push.*--force",
        r"(?i)\"claude@users\.noreply\.github\.com\".*\"AI-generated|Automated PR\"",
    ]),
    "authenticated_spoof_push": (95, [r"(?i)process\.env\.GITHUB_TOKEN.*git\s+commit.*git\s+push", r"(?i)github_token.*--author.*noreply.*push.*--force"]),
    "repo_hijacking": (85, [
        r"(?i)git\s+config.*user\.email.*noreply\.github\.com", r"(?i)git\s+config.*user\.name.*claude|gpt|openai|anthropic|cursorde|gemini",
        r"(?i)\"author\":\s*\"claude@users\.noreply\.github\.com\"",
    ]),
})

D24 = Detector("once", 80, 60, {
    "bun_binary_execution": (85, [
        r"bun\s+run(?!\s+test)", r"bun\s+execute", r"spawn.*['\"]bun['\"]", r"child_process\.spawn\s*\(\s*['\"]bun['\"]", r"child_process\.exec\s*\(\s*['\"]bun", r"require\s*\(\s*['\"]bun['\"]\)",
    ]),
    "bun_api_usage": (75, [r"Bun\.serve\s*\(", r"Bun\.file\s*\(", r"Bun\.write\s*\(", r"Bun\.spawn\s*\(", r"Bun\.shell\s*\(", r"import\s+Bun\s+from\s+['\"]bun['\"]"]),
    "process_argv_swap": (80, [r"process\.argv\[0\].*=.*bun", r"process\.mainModule.*bun", r"process\.execPath.*bun"]),
    "bun_downloader": (90, [
        r"curl.*https://bun\.sh", r"wget.*https://bun\.sh", r"fetch.*https://github\.com/oven-sh/bun.*releases", r"(?i)download.*bun.*binary|install.*bun.*runtime",
    ]),
    "bun_credential_combo": (95, [r"bun\s+run.*AWS|bun\s+run.*GITHUB|bun\s+run.*fetch.*env", r"(?i)Bun\.spawn.*AWS|Bun\.spawn.*credential|Bun\.spawn.*token"]),
    "node_to_bun_swap": (90, [r"child_process\.spawn.*node.*bun", r"spawn.*node.*then.*bun", r"spawn\s*\(\s*['\"]node['\"].*['\"]bun['\"]"]),
})

D25 = Detector("once", 80, 60, {
    "syspath_searching": (85, [r"sys\.path", r"sys\.path\.append|sys\.path\.insert", r"os\.path\.join.*sys\.path", r"__import__\s*\(", r"importlib\.import_module"]),
    "dynamic_require": (80, [
        r"require\s*\(\s*\$\{|require\s*\(\s*`.*\$", r"require\s*\(\s*\w+\s*\+\s*['\"]", r"require\s*\(\s*path\.join.*\)", r"require\.resolve\s*\(\s*\w+\s*\)",
    ]),
    "eval_with_fetched_code": (95, [
        r"eval\s*\(\s*fetch|eval\s*\(\s*.*http", r"eval\s*\(\s*fs\.readFileSync", r"Function\s*\(\s*fetch|Function\s*\(\s*.*http", r"new\s+Function\s*\(\s*['\"]", r"eval\s*\(\s*Buffer\.",
    ]),
    "buffer_assembly": (80, [r"Buffer\.concat\s*\(", r"\.join\s*\(\s*['\"]['\"]\s*\)", r"split\s*\(\s*['\"]['\"]\s*\).*join", r"\.flatMap\s*\(\s*Buffer"]),
    "multifile_traversal": (75, [r"require\s*\(\s*['\"]\.\./", r"require\s*\(\s*['\"]\.\.", r"fs\.readFileSync.*\.\./"]),
    "obfuscated_assembly": (70, [r"Buffer\.from\s*\(\s*['\"]", r"atob\s*\(", r"JSON\.parse\s*\(\s*JSON\.stringify\s*\(", r"btoa\s*\("]),
    "dynamic_discovery": (70, [r"fs\.readdirSync.*filter|fs\.readdirSync.*map", r"glob\s*\(|minimatch\(", r"walkSync\s*\(", r"fs\.readdirSync\s*\(\s*['\"]\."]),
    "payload_assembly_chain": (99, [r"fs\.readdirSync.*eval|glob.*eval|walkSync.*eval", r"Buffer\.concat.*eval|eval.*Buffer\.concat", r"require\s*\(\s*\w+.*eval\s*\("]),
})

CONTENT = {
    "D15-MEMORY-EXTRACTION": D15, "D16-EBPF-ROOTKIT": D16, "D17-PRIVILEGE-ESCALATION": D17, "D18-SELF-DEFENDING": D18,
    "D19-MODULE-LOAD": D19, "D20-PROFILING-RECON": D20, "D21-SELF-CLEANING": D21, "D22-AI-TOKEN-TARGETING": D22,
    "D23-GITHUB-AUTHOR-SPOOF": D23, "D24-BUN-RUNTIME-SWAP": D24, "D25-SPLIT-DYNAMIC-PAYLOAD": D25,
}

#: Signals that occur in plain text, for tables that hold no source code.
PLAIN = Detector("each", 75, 55, {
    "hex_token": (60, [r"[0-9a-f]{40}"]),
    "ip_address": (20, [r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"]),
    "access_key": (55, [r"AKIA[A-Z0-9]{16}"]),
    "credential_word": (15, [r"(?i)(token|secret|password|api_key)"]),
})

# Build files: each pattern is a type of its own; the three tables see files of different kinds.
D14_GYP = Detector("each", 99, 70, {
    "shell_exec": (50, [r"<!?\(.*\)"]), "process_spawn": (45, [r"\b(spawn|exec|execSync|spawnSync|fork)\s*\("]), "env_access": (35, [r"process\.env\."]),
    "fs_access": (40, [r"\bfs\.(read|write|readFile|writeFile|readdir|exists|stat|mkdir|rm|unlink)"]), "http_request": (50, [r"(?i)\b(http|https|curl|wget|fetch)\b"]),
    "path_traversal": (55, [r"\.\./"]), "compile_macro_injection": (60, [r"-D\s*['\"]?[A-Z_]+=(system|exec|shell|popen|fork)"]),
    "include_path_manipulation": (55, [r"-I\s*\.\./\.\./(?:tmp|var|dev|private|etc)"]), "linker_library_injection": (50, [r"['\"](?:-lcurl|libcurl|-lssl|libssl|-lpcap|libpcap|-lkqueue)['\"]"]),
})
D14_BUILD = Detector("each", 99, 70, {
    "makefile_shell_exec": (50, [r"\$\(shell\s+[^)]+\)"]), "cmake_execute_process": (50, [r"\bexecute_process\s*\([^)]*COMMAND\b"]),
    "cmake_custom_command": (50, [r"\badd_custom_command\s*\([^)]*(COMMAND|DEPENDS)"]), "cmake_custom_target": (50, [r"\badd_custom_target\s*\([^)]*(COMMAND|DEPENDS)"]),
    "makefile_curl_download": (50, [r"\b(curl|wget|fetch)\s+(--insecure|-k\s+)?(http|https):"]), "makefile_npm_publish": (50, [r"\bnpm\s+(publish|version|dist-tag)"]),
})
D14_SOURCE = Detector("each", 99, 70, {
    "hardcoded_key": (60, [r"(?:AWS|GITHUB|SLACK|STRIPE|TOKEN|SECRET|API_KEY|PASSWORD)\s*[:=]\s*['\"][A-Za-z0-9_-]{20,}['\"]|['\"](?:sk_live_|sk_test_|ghp_|gho_|ghs_|ghu_)[A-Za-z0-9_-]{20,}['\"]"]),
    "getenv_call": (35, [r"\b(getenv|secure_getenv|getenv_s)\s*\("]), "curl_call": (45, [r"\b(curl_easy_perform|curl_slist_append|CURLOPT_URL|curl_easy_setopt)\s*\("]),
    "execve_call": (55, [r"\b(execve|execvp|execl|execlp|system|popen|pclose)\s*\("]), "credential_scan": (50, [r"(~/\.aws|~/\.ssh|\.env|credentials\.json|/etc/passwd)"]),
    "socket_call": (40, [r"\b(socket\s*\(|listen\s*\(|accept\s*\(|connect\s*\(AF_)"]), "environ_access": (35, [r"\b(environ|__environ)\s*\["]),
})
BUILD_FILES = {
    r"(^|/)[^/]*\.gypi?$": D14_GYP, r"(^|/)(Makefile|GNUmakefile|CMakeLists\.txt|[^/]*\.(mk|cmake))$": D14_BUILD, r"\.(c|cc|cpp|h|hpp)$": D14_SOURCE,
}
