"""Word lists, lookup tables and constants that results depend on.

Every list keeps its natural order, because result lists follow dictionary order.
"""

# Skill dictionary, searched in posting and resume text as whole tokens.
SKILL_TERMS = [
    "Azure", "AWS", "Google Cloud", "GCP", "OpenStack",
    "Kubernetes", "Docker", "Containerd", "Podman", "Helm", "OpenShift", "K8s",
    "Terraform", "Ansible", "CloudFormation", "Puppet", "Chef", "Pulumi", "Packer",
    "CI/CD", "Jenkins", "GitHub Actions", "GitLab CI", "ArgoCD", "CircleCI",
    "Bitbucket Pipelines",
    "Prometheus", "Grafana", "ELK", "Elasticsearch", "Datadog", "Splunk", "CloudWatch",
    "OpenTelemetry", "Nagios",
    "Linux", "Ubuntu", "CentOS", "RHEL", "Bash", "Shell", "Python", "Go", "Golang",
    "PowerShell", "Git",
    "TCP/IP", "DNS", "VPN", "IAM", "VPC", "SSL/TLS", "Vault", "SonarQube", "Trivy",
    "REST API", "Microservices", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Kafka",
    "RabbitMQ", "Java", "Spring Boot", "Node.js", "C++", "Rust",
]

# Cloud label -> substrings that count as a mention in a posting.
CLOUD_ALIASES = {
    "AZURE": ["azure", "microsoft azure", "aks", "azure devops", "avd", "azure monitor"],
    "AWS": ["aws", "amazon web services", "ec2", "s3", "eks", "lambda", "cloudformation"],
    "GCP": ["gcp", "google cloud", "google cloud platform", "gke"],
}

# Cloud names searched in a resume.
RESUME_CLOUDS = [
    "Azure", "AWS", "GCP", "Google Cloud", "Oracle Cloud", "IBM Cloud", "Alibaba Cloud",
]

# Certifications searched in a resume as whole tokens.
CERTIFICATIONS = [
    "AZ-104", "AZ-900", "AZ-305", "AZ-400", "AZ-500",
    "AWS Certified Solutions Architect", "AWS Certified Cloud Practitioner",
    "AWS Certified DevOps Engineer", "AWS Certified SysOps",
    "CKA", "CKAD", "CKS", "Certified Kubernetes Administrator",
    "HashiCorp Certified: Terraform Associate", "Terraform Associate",
    "RHCSA", "RHCE", "CompTIA Security+", "CompTIA Network+",
]

# Degrees searched in a resume as substrings.
DEGREES = [
    "B.Tech", "B.E.", "Bachelor of Technology", "Bachelor of Engineering",
    "Bachelor of Science", "B.Sc", "BCA", "MCA", "M.Tech", "M.S.", "Master of Science",
]

# Substrings of a posting that mean a degree is asked for.
DEGREE_HINTS = ["bachelor", "b.tech", "b.e.", "degree in computer science", "master"]

# Words deleted from a company name before it becomes part of a key (tried in this order).
COMPANY_NOISE = [
    "in india", "india", "pvt ltd", "private limited", "ltd", "limited", "llc", "inc",
    "corporation", "corp", "technologies", "solutions", "services",
    "global capability center",
]

# Title pieces deleted before a title becomes part of a key.
TITLE_NOISE = r"irc\d+|walk-in drive|\d+th sep \d+"

# Seniority ladder: substrings of the lower-cased title, first level that hits wins.
SENIORITY_TITLE = [
    ("ARCHITECT", ["architect", "architecture"]),
    ("LEAD", ["lead", "tech lead", "team lead", "head"]),
    ("PRINCIPAL", ["principal", "staff", "distinguished"]),
    ("MANAGER", ["director", "vp", "manager", "management"]),
    ("SENIOR", ["senior", "sr.", "sr ", "sr-", "l3", "level 3", "iii"]),
    ("ENTRY", ["junior", "jr.", "jr ", "entry", "intern", "trainee", "graduate"]),
    ("ASSOCIATE", ["associate", "l1", "l2"]),
]
# Fallback: substrings of the posting's stated level.
SENIORITY_LEVEL = [
    ("MANAGER", ["director", "executive"]),
    ("SENIOR", ["mid-senior"]),
    ("ENTRY", ["entry"]),
    ("ASSOCIATE", ["associate"]),
]
SENIORITY_DEFAULT = "STANDARD"
SENIOR_GROUP = ["LEAD", "ARCHITECT", "PRINCIPAL", "MANAGER"]

# Years assumed when the text names none.
YEARS_BY_SENIORITY = {
    "ARCHITECT": 7.0, "PRINCIPAL": 8.0, "LEAD": 6.0, "MANAGER": 7.0, "SENIOR": 4.0,
    "ASSOCIATE": 1.5, "ENTRY": 0.5,
}

# Domain by title substring, first domain that hits wins.
DOMAIN_TITLE = [
    ("cloud_devops", ["cloud", "devops", "sre", "site reliability", "platform engineer",
                      "infrastructure", "infra"]),
    ("software_engineering", ["java", "spring", "c#", ".net", "backend", "full stack",
                              "frontend", "react", "angular", "node"]),
    ("data_ai", ["data engineer", "data scientist", "machine learning", "mlops",
                 "ai engineer"]),
]
# Otherwise: counts of these substrings in the text decide.
CLOUD_DOMAIN_TERMS = ["devops", "kubernetes", "terraform", "ci/cd", "infrastructure",
                      "cloud engineer"]
SOFTWARE_DOMAIN_TERMS = ["java", "spring boot", "c#", "react", "frontend",
                         "backend developer"]

# Required-years patterns in the order tried: (pattern, has an upper bound, lowest value kept).
_N = r"(\d+(?:\.\d+)?)"
_Y = r"(?:years?|yrs?)"
REQUIRED_YEARS = [
    (r"(?i)(?:experience|exp|total exp|relevant exp|industry exp)\s*[:\-]?\s*" + _N
     + r"\s*(?:-|to|\+)?\s*" + _N + r"?\s*" + _Y, True, 0.5),
    (r"(?i)(?:minimum|at least|min\.?)\s*" + _N + r"\s*(?:-|to|\+)?\s*" + _N + r"?\s*" + _Y,
     True, 0.5),
    (r"(?i)" + _N + r"\+?\s*" + _Y + r"(?:\s+of)?\s+(?:work\s+experience|relevant\s+experience"
     r"|industry\s+experience|hands-on\s+experience|experience|exp)", False, 0.5),
    (r"(?i)" + _N + r"\s*(?:-|to)\s*" + _N + r"\s*" + _Y, True, 0.5),
    (r"(?i)" + _N + r"\+?\s*" + _Y, False, 1.0),
]
REQUIRED_YEARS_MAX = 30.0

# Resume-years patterns in the order tried.
RESUME_YEARS = [
    r"(?i)" + _N + r"\+?\s*" + _Y + r"(?:\s+of)?\s+(?:experience|exp)",
    r"(?i)(?:experience|exp):\s*" + _N + r"\s*" + _Y,
    r"(?i)" + _N + r"\s*" + _Y,
]
RESUME_YEARS_RANGE = (0.5, 35.0)
RESUME_YEARS_DEFAULT = 1.0

# Salary phrase in a description.
SALARY = (r"(?i)(\$|₹|INR|USD)\s?[\d,]+(?:\s?-\s?(\$|₹|INR|USD)?\s?[\d,]+)?"
          r"(?:\s?(?:k|lac|lpa|year|hr|month))?")

# Feed: title and level substrings hidden under the strict experience cap.
STRICT_CAP_YEARS = 3.0
STRICT_TITLE_BLOCK = ["senior", "sr.", "sr ", "sr-", "lead", "principal", "staff",
                      "architect", "director", "manager"]
STRICT_LEVEL_BLOCK = ["mid-senior", "director"]

# Status precedence when duplicates merge; anything unknown ranks like 'new'.
STATUS_RANK = {"applied": 5, "rejected": 4, "saved": 3, "ignored": 2, "new": 1}

PRIORITY_ORDER = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}

# Skills that count as core stack in the fit score.
CORE_STACK = ["azure", "aws", "kubernetes", "terraform", "docker", "ci/cd", "linux", "python"]

# Two normalised titles of one company are the same posting from this ratio on.
TITLE_SIMILARITY = 0.88

# Search parameters: recency codes in seconds, work-type codes, page size, preset roles.
RECENCY_SECONDS = {"r86400": 86400, "r604800": 604800, "": None}
WORK_TYPES = {"1": "On-site", "2": "Remote", "3": "Hybrid", "": None}
PAGE_SIZE = 25
PRESET_ROLES = [
    "Azure Cloud Engineer", "DevOps Engineer", "Cloud Engineer", "Junior DevOps Engineer",
    "Site Reliability Engineer", "Platform Engineer", "AWS DevOps Engineer",
    "Kubernetes Specialist",
]
FALLBACK_ROLE = "Cloud Engineer"

# Posting defaults.
UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_COMPANY = "Unknown Company"

# Field defaults of a profile, and the profile used when none is stored.
PROFILE_DEFAULTS = {
    "candidate_name": "Candidate",
    "target_roles": ["Cloud Engineer", "DevOps Engineer", "SRE"],
    "years_experience": 1.0,
    "location": "India",
    "skills": [],
    "cloud_platforms": [],
    "certifications": [],
    "education": [],
    "summary": "",
    "raw_text": "",
}
EMPTY_RESUME_SUMMARY = "Cloud / DevOps Engineer"
DEFAULT_PROFILE = {
    "candidate_name": "Cloud / DevOps Engineer",
    "target_roles": ["Cloud Engineer", "DevOps Engineer", "Site Reliability Engineer",
                     "Platform Engineer"],
    "years_experience": 1.0,
    "location": "India",
    "skills": ["Azure", "AWS", "Kubernetes", "Terraform", "Docker", "Linux", "Python", "CI/CD",
               "Git", "Bash", "Prometheus", "Grafana"],
    "cloud_platforms": ["Azure", "AWS"],
    "certifications": ["AZ-104 Microsoft Azure Administrator"],
    "education": ["Bachelor of Technology in Computer Science"],
    "summary": "Cloud and DevOps Engineer with hands-on experience in Azure, AWS, Kubernetes, "
               "Terraform, Docker, and CI/CD pipelines.",
    "raw_text": "",
}
