"""Own postings whose results are worked out by hand in the tests that use them."""

from vacantia.schema import POSTING

FIELDS = ["posting_id", "title", "company", "location", "url", "posted_at", "employment_type",
          "experience_level", "work_mode", "salary", "description"]

POSTINGS = [
    ("k-11", "Platform Trainee", "Harbour Lights Ltd", "Pune, India", "u1", "2 days ago",
     "Contract", "Associate", "Hybrid", "₹6,00,000",
     "Our small crew keeps ferry booking online. Minimum 1 year with Azure, Docker and Linux; "
     "Terraform helps you along."),
    ("k-12", "Senior Java Developer", "Quartz Mills", "Chennai, India", "u2", "5 days ago",
     "Full-time", "Director", "On-site", "",
     "A mill runs on its planning tool. 8+ years of Java and Kafka on PostgreSQL, and some AWS."),
    ("k-13", "Lead Data Engineer", "Night Owl Freight", "Remote", "u3", "1 hour ago", "Full-time",
     "Mid-Senior level", "Remote", "$90,000",
     "Freight never sleeps. 5+ years of experience in Python and GCP; Grafana boards are yours."),
    ("k-14", "Support Analyst", "Tin Drum", "Delhi, India", "u4", "Reposted 4 days ago",
     "Part-time", "Entry level", "On-site", "", "Help desk shifts, Linux basics and patience."),
]

DUPLICATE = ("k-99", "Platform Trainee", "Harbour Lights", "Kochi, Kerala, India", "u9",
             "10 minutes ago", None, None, None, None, "Shorter notice, Azure and Docker.")


def batch(spark, rows):
    schema = "seq long, " + ", ".join(f"{f} string" for f in FIELDS)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def empty_store(spark):
    return spark.createDataFrame([], POSTING)
