"""tesseral: a Spark-native engine for corpus engineering, findings analytics, retrieval, rewards and evaluation."""
