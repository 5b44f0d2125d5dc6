"""tarnflow.plans"""
