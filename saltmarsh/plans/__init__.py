"""Multi-operator jobs: medallion run, upload job, retrieval, news store, index build."""
