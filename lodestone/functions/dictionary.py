"""Defaults for real postings: terms, what they imply, headings and roles of sections. Callers may replace any of them.

``vocabulary`` holds the lists for the synthetic texts, in the same shapes.
"""

from __future__ import annotations


def _rows(text: str, exact: bool) -> tuple[tuple[str, str, bool], ...]:
    """(canonical, alias, case-sensitive) of lines ``name = other spelling, other spelling``."""
    out = []
    for line in text.strip().splitlines():
        name, _, more = line.partition("=")
        names = [name, *more.split(",")]
        out += [(name.strip(), n.strip() if exact else n.strip().lower(), exact) for n in names if n.strip()]
    return tuple(out)


TERMS = _rows(
    """
    Python
    Java
    Scala
    Kotlin
    JavaScript = ecmascript
    TypeScript
    C++ = cpp
    C# = csharp
    SQL
    PostgreSQL = postgres
    MySQL
    SQLite
    MongoDB = mongo
    Redis
    Elasticsearch = elastic search
    Kafka = apache kafka
    Spark = apache spark
    PySpark
    Hadoop
    Airflow = apache airflow
    Flink = apache flink
    Snowflake
    BigQuery = big query
    Redshift
    AWS = amazon web services
    Google Cloud = gcp
    Azure = microsoft azure
    Docker
    Kubernetes = k8s
    Terraform
    Ansible
    Linux
    Git
    Jenkins
    GraphQL
    gRPC
    React = react.js, reactjs
    Angular
    Vue = vue.js, vuejs
    Node.js = nodejs
    Django
    Flask
    FastAPI = fast api
    Spring Boot = springboot
    pandas
    NumPy
    scikit-learn = sklearn
    PyTorch
    TensorFlow
    Machine learning = ml engineering
    Deep learning
    Tableau
    Power BI = powerbi
    Selenium
    Playwright
    Unit testing = unit tests
    CI/CD = continuous integration
    Microservices = micro services
    """,
    False,
) + _rows("Go = Golang\nR\nREST = RESTful\nETL = ELT\nNLP\nLLM = LLMs", True)
IMPLIES = (
    ("PostgreSQL", "SQL"), ("MySQL", "SQL"), ("SQLite", "SQL"), ("BigQuery", "SQL"), ("Redshift", "SQL"), ("Snowflake", "SQL"), ("PySpark", "Spark"), ("PySpark", "Python"),
    ("Django", "Python"), ("Flask", "Python"), ("FastAPI", "Python"), ("pandas", "Python"), ("NumPy", "Python"), ("scikit-learn", "Machine learning"), ("PyTorch", "Deep learning"),
    ("TensorFlow", "Deep learning"), ("Deep learning", "Machine learning"), ("Spring Boot", "Java"), ("TypeScript", "JavaScript"), ("React", "JavaScript"), ("Angular", "TypeScript"),
    ("Vue", "JavaScript"), ("Node.js", "JavaScript"), ("Redshift", "AWS"), ("BigQuery", "Google Cloud"),
)
#: (priority, kind, pattern): the first that is found in a heading, in lower case, names its kind.
HEADING_RULES = (
    (1, "ignore", "\\b(about (us|the (company|team))|who we are|benefits|perks|we offer|compensation|salary|pay range|equal opportunit|how to apply|privacy|our (values|story))\\b"),
    (2, "preferred", "\\b(nice[ -]to[ -]ha(ve|s)|bonus( points)?|preferred|desir(ed|able)|ideally|pluses|would be great|good to have)\\b"),
    (3, "required", "\\b(requirements?|required|qualifications?|must[ -]ha(ve|ves)|minimum|essential|you (bring|have|need)|your (profile|background|skills|experience)|we('re| are) looking for|what it takes)\\b"),
    (4, "duties", "\\b(responsibilit(y|ies)|duties|tasks|you('ll| will) (do|work|own)|day[ -]to[ -]day|your (role|mission|impact)|the (role|job|position)|in this role)\\b"),
)
#: A line that matches this inside a required section only counts as preferred.
PREFERRED_LINE = "\\b(nice to have|a (big )?plus|bonus|preferred|preferably|desirable|ideally|advantage)\\b"
#: (role, parts): the first role of which a heading holds a part, in lower case.
ROLES = (
    ("projects", ("project", "portfolio", "open source")), ("experience", ("experience", "employment", "work history", "career")), ("education", ("education", "degree", "studies", "academic")),
    ("skills", ("skill", "technolog", "tools", "languages")), ("summary", ("summary", "profile", "about me", "objective")),
)
