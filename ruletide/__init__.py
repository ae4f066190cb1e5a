"""A Spark-native engine for temporal rules over keyed, time-stamped relations."""
