"""tarnflow.sources"""
